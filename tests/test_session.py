from types import SimpleNamespace

import pytest

from tacitra.session import ensure_checkpoint_dir


def test_no_private_checkpoint_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master, fails in (("spark://host:7077", True), ("local-cluster[2,1,1024]", True), ("local[4]", False), ("local", False)):
        seen = []
        sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master=master, setCheckpointDir=seen.append)
        session = SimpleNamespace(sparkContext=sc, conf=conf)
        if fails:
            with pytest.raises(RuntimeError):
                ensure_checkpoint_dir(session)
        else:
            ensure_checkpoint_dir(session)
            assert len(seen) == 1
