import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tacitra.operators.unpack import split_packed, unpack_fields

CASES = [
    (None, []),
    ("", []),
    (" ; , | ", []),
    ("a@x.example", ["a@x.example"]),
    ('"Last, First" <A.B@X.example>, c@y.example', ["a.b@x.example", "c@y.example"]),
    ('"Everquill; Sue" <s@x.example>; First Last <f@x.example>', ["s@x.example", "f@x.example"]),
    ('"Jen \\"Je\\" Frost" <j@x.example>', ["j@x.example"]),
    ('"f@x.example" (Fi)', ["f@x.example"]),
    ('"f@x.example" (Fi, x) g@x.example', ["f@x.example", "g@x.example"]),
    ("mailto:a@x.example", ["a@x.example"]),
    ("'a@x.example'", ["a@x.example"]),
    ("'ann'.b@x.example", ["'ann'.b@x.example"]),
    ("''ann'.b@x.example'", ["'ann'.b@x.example"]),
    (".b@x.example", [".b@x.example"]),
    ("a@x.example / b@x.example/c@x.example | d@x.example", ["a@x.example", "b@x.example", "c@x.example", "d@x.example"]),
    ("a@x.example b@x.example  c@x.example\td@x.example", ["a@x.example", "b@x.example", "c@x.example", "d@x.example"]),
    ("a@x.example,\r\n\tb@x.example,", ["a@x.example", "b@x.example"]),
    (", ,a@x.example,,b@x.example, ", ["a@x.example", "b@x.example"]),
    ("a@x.example, a@x.example", ["a@x.example", "a@x.example"]),
    ("Last, First", ["Last, First"]),
    ('"Last, First"; Last, Two | Third Co', ["Last, First", "Last, Two", "Third Co"]),
    ('"A, B", "C, D"', ["A, B", "C, D"]),
    ("Zoë Ängström <zoë@x.example>", ["zoë@x.example"]),
    ('"open <a@x.example>, b@x.example', ["a@x.example", "b@x.example"]),
    ("a@x.example (open, b@x.example", ["a@x.example", "b@x.example"]),
    ("Sales, North <s@x.example>", ["s@x.example"]),
    ("a@x.example, Tail Name", ["a@x.example", "Tail Name"]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_one_field(text, expected):
    assert split_packed(pa.array([text], pa.string())).to_pylist() == [expected]


def test_all_fields_in_one_batch():
    """Nothing spills from one row into its neighbours, sliced arrays included."""
    texts = [t for t, _ in CASES] * 3
    whole = pa.array(["x@y, \"", *texts], pa.string())
    assert split_packed(whole.slice(1)).to_pylist() == [e for _, e in CASES] * 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.from_regex(r"\A[a-z]{1,4}\.?[a-z]{1,4}@[a-z]{1,5}\.example\Z"), max_size=6), max_size=8), st.sampled_from([", ", ";", " | ", "\n", "/", "\t", "  ", ",\n\t"]))
def test_round_trip(rows, sep):
    assert split_packed(pa.array([sep.join(r) for r in rows], pa.string())).to_pylist() == rows


def test_long_field():
    many = [f"p{i}@x.example" for i in range(20000)]
    assert split_packed(pa.array([", ".join(many)])).to_pylist() == [many]


def test_frame(spark):
    df = spark.createDataFrame([(1, "a@x.example, b@x.example", None, "z"), (1, "a@x.example, b@x.example", None, "z"), (2, None, " ", None)], "row_id bigint, to string, cc string, value string")
    out = unpack_fields(df, "row_id", ["to", "cc"])
    assert out.columns == ["row_id", "field", "pos", "value"]
    assert sorted(map(tuple, out.collect())) == sorted([(1, "to", 1, "a@x.example"), (1, "to", 2, "b@x.example")] * 2)
    assert unpack_fields(df.limit(0), "row_id", ["to"]).count() == 0


def test_against_regex_on_addresses():
    """Fields of bare addresses alone: a regular expression finds the same."""
    text = "a.b@x.example;c@y.example , d_e@z.example|f@x.example"
    assert split_packed(pa.array([text])).to_pylist()[0] == re.findall(r"[\w.]+@[\w.]+", text)
