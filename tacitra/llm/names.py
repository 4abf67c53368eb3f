"""Given names with their short forms, shared by the operators on persons."""

from __future__ import annotations

import unicodedata

# A prior of common given names (grammatical gender of the usual bearer) with the short forms typed for them.
# The corpus itself adds those it shows (llm/evidence.py).
GIVEN = {
    "alexandra": ("f", "alex lexi sandra"),
    "anais": ("f", ""),
    "anthony": ("m", "tony"),
    "barbara": ("f", "barb babs"),
    "bjorn": ("m", ""),
    "charles": ("m", "charlie chuck chas"),
    "christopher": ("m", "chris kit topher"),
    "daniel": ("m", "dan danny"),
    "deborah": ("f", "deb debbie debby"),
    "dorothea": ("f", "dot dottie thea"),
    "edward": ("m", "ed eddie ned edw"),
    "elizabeth": ("f", "liz beth betty eliza lizzie betsy"),
    "fiona": ("f", "fi"),
    "frederick": ("m", "fred freddie fritz"),
    "gideon": ("m", "gid"),
    "gregory": ("m", "greg"),
    "hana": ("f", ""),
    "ingrid": ("f", "inga"),
    "james": ("m", "jim jimmy jamie jas"),
    "jennifer": ("f", "jen jenny jenn"),
    "jose": ("m", "pepe"),
    "jurgen": ("m", ""),
    "katherine": ("f", "kate kathy katie kath kat kay"),
    "lawrence": ("m", "larry lars laurie"),
    "lucia": ("f", "lucy"),
    "margaret": ("f", "peggy meg maggie marge"),
    "michael": ("m", "mike mick mich mickey"),
    "nadine": ("f", ""),
    "odette": ("f", ""),
    "oleg": ("m", ""),
    "patricia": ("f", "pat patty trish tricia"),
    "priya": ("f", ""),
    "quentin": ("m", ""),
    "rebecca": ("f", "becky becca reba"),
    "rene": ("m", ""),
    "richard": ("m", "rick rich dick ricky"),
    "robert": ("m", "rob bob bobby robt bert"),
    "ruben": ("m", ""),
    "samuel": ("m", "sam sammy"),
    "steven": ("m", "steve stephen"),
    "susan": ("f", "sue susie suzy"),
    "theodore": ("m", "theo ted teddy"),
    "thomas": ("m", "tom tommy thos"),
    "tomasz": ("m", "tomek"),
    "ulrich": ("m", "uli"),
    "veronica": ("f", "ronnie vera ronni"),
    "victoria": ("f", "vicky tori vicki"),
    "wendell": ("m", ""),
    "william": ("m", "bill billy wm willy liam"),
    "yusuf": ("m", ""),
    "zelda": ("f", ""),
    "zoe": ("f", ""),
}
# More given names of the prior, without short forms of their own but for those in MORE_SHORT.
MORE = {
    "m": """aaron adam ahmed alan albert andrew antonio arthur benjamin brandon brian bruce carl carlos colin craig curtis david dennis derek dmitri donald douglas eric eugene
    gary george graham harold hassan henry howard hugh ian igor ivan jason jeffrey jerry john jonathan joseph joshua juan keith kenneth kevin leonard louis luis marcus mark martin
    matthew miguel mohammed nathan neil nicholas nigel omar patrick paul pedro peter philip pierre ralph raymond roger ronald russell ryan scott sean sergei simon stanley stefan
    stuart timothy todd trevor vijay vincent vladimir walter wolfgang""".split(),
    "f": """alice amanda amy andrea angela ann anna anne anita ashley astrid beverly brenda brigitte carmen carol carolyn catherine cheryl christine claire claudia cynthia denise
    diane donna dorothy elena emily emma evelyn fatima gloria greta hannah heather heidi helen isabel jacqueline janet janice jessica joan joyce judith julia julie karen kathleen
    laura linda lisa louise maria marilyn martha mary megan melissa michelle monica nancy nicole olga olivia pamela petra rachel sabine samantha sandra sara sarah sharon shirley sonia
    sophia sophie stephanie svetlana teresa ursula vivian wendy yvonne""".split(),
}
MORE_SHORT = {
    "andrew": "andy", "benjamin": "ben", "cynthia": "cindy", "david": "dave", "donald": "don", "douglas": "doug", "jacqueline": "jackie", "jeffrey": "jeff", "john": "johnny", "jonathan": "jon",
    "joseph": "joe joey", "joshua": "josh", "judith": "judy", "kenneth": "ken kenny", "leonard": "lenny", "matthew": "matt", "nicholas": "nick", "pamela": "pam", "peter": "pete",
    "philip": "phil", "ronald": "ron", "stanley": "stan", "timothy": "tim", "vincent": "vince", "walter": "walt",
}
# Given names that are words as well: they count only with a family name behind them, a comma form or a title.
ALSO_WORDS = frozenset("mark carol don".split())
GIVEN |= {name: (gender, MORE_SHORT.get(name, "")) for gender, names in MORE.items() for name in names if name not in GIVEN}
SHORT = {s: full for full, (_, shorts) in reversed(GIVEN.items()) for s in shorts.split()}  # of several full names the first

SHORT_ALSO = {"ted": "edward", "kit": "katherine", "kat": "katherine"}


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
