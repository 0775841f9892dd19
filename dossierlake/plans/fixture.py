"""Small lexicons and patterns that the registered queries pass to the operators; parameters, not part of them."""

from ..functions.lexicon import Entry, FindingRule
from ..operators.opinions import Case, Guide, Profile

LEX = (
    Entry("LIC", 3, ("license", "mit ")),
    Entry("ENG", 2, ("the ", "tion")),
    Entry("FRA", 2, ("eaux", "eux")),
    Entry("ESP", 2, ("ción",)),
    Entry("GER", 2, ("ung", "sch")),
)
FAMILIES = (
    Entry("complete", pattern="ing|tion|ung"),
    Entry("method", pattern="the|que|der"),
    Entry("split", pattern="[0-9]+"),
    Entry("logic", pattern="and|ent|und"),
)
INTENTS = {"complete": ("guide", "accept"), "method": ("guide", "quality"), "split": ("price",), "logic": ("guide", "order")}
PATTERNS = {"normative": "the|der|que", "publish": "icense", "roster": "anand", "toc": r"\|", "placeholder": "xxxx|%%%", "front": r"\*\*\*", "leaders": r"[.]{6,}"}
CHECKPOINTS = (
    Entry("grant", keywords=("license", "the"), extra=("license", "permission")),
    Entry("quantity", keywords=("ing", "que"), extra=("tion", "ent")),
    Entry("order", keywords=("ung", "and"), extra=("und", "with")),
)
ARTIFACTS = (("basis", ("re", "er")), ("photo", ("ph", "oto")))
FINDINGS = (
    FindingRule("no_license", (("the ", "der "),), none_of=("license",), message="licence missing"),
    FindingRule("parts", (("tion", "ción"), ("ing", "que")), needs=("license", "ouen", "quell"), message="items missing"),
    FindingRule("markup", (("%%%", "***"),), message="markup left"),
)
#: Domains: a term in an opinion, and what a text of that domain holds.
GUARD = (("the ", ("the ", "and ")), ("ción", ("ción", "que ")), ("ung", ("der ", "Die ")))
#: Rules as rows: id, priority, condition, message, items as (name, condition).
CONDITIONS = (
    ("far_terms", 2, '{"and": [{"any": ["license", "copyright"]}, {"not": {"near": [["license"], ["copyright", "notice"]], "within": 60, "stop": "."}}]}', "terms apart", ()),
    ("amounts", 1, '{"or": [{"value": ["the", "la", "der"], "unit": [], "within": 20, "stop": ".", "least": 10, "most": 99.5}, {"number": ["%", "mm", "days"]}]}', "amounts", (("bounded", '{"threshold": true}'), ("few", '{"value": ["of", "de"], "within": 30, "stop": ".", "most": 5}'))),
    ("order", 3, '{"and": [{"before": [["license"], {"pattern": "software|files?"}], "within": 200, "stop": "@"}, {"all": ["the", "of"]}]}', "order told", ()),
    ("bare", 1, '{"not": {"any": ["the", "der", "que", "la"]}}', "no plain words", (("letters", '{"pattern": "[a-z]{3}"}'),)),
)
#: A checkpoint on the order of mention: covered, then the reversed order, then a bare mention.
ORDERED = (("covered", '{"before": [["ing"], ["ent"]], "within": 40, "stop": "."}'), ("missing", '{"before": [["ent"], ["ing"]], "within": 40, "stop": "."}'), ("vague", '{"any": ["ing", "ent"]}'))
PRICES = (("red", 950.0), ("PROMO", 0.0))
STOP = ("the", "of", "and", "to")


ATTRIBUTIONS = (Entry("basis", pattern="er|ent"), Entry("scope", pattern="la|le"), Entry("grant", pattern="icense"))
PROFILES = {
    "basis": Profile("basis of work", "which basis holds", "work without a basis cannot be checked", "find the basis first", ("is it named", "is it current"), ("drawing",)),
    "scope": Profile("scope of work", "where does it end", "open limits are paid twice", "draw the limits first", ("are the limits drawn",), ("plan", "list")),
    "grant": Profile("grant", "who allows it", "work may stop", "ask for the grant", (), ("licence",)),
    "judgement": Profile("expert judgement", "does it apply here", "no case is like another", "go back to the text", ("same object",), ("note",)),
}
GUIDE = Guide(
    patterns=FAMILIES,
    attributions=ATTRIBUTIONS,
    labels={"complete": "parts left out", "method": "unfit method", "split": "work not split", "logic": "order at odds"},
    profiles=PROFILES,
    intents=INTENTS,
    usual=({"complete": "guide", "method": "quality"}, "review"),
    risks=((Case("grant at risk", words=("license", "MIT ")), Case("price at risk", pattern="split"), Case("order at risk", pattern="logic"), Case("gaps on site", dimension="complete")), "loop stays open"),
    fixes=({"complete": "add to {category}: parts and limits", "split": "split the work"}, "state {category} with limits"),
    asks=({"complete": ("material", "acceptance")}, ("sequence",)),
    backgrounds=({"complete": "{category} needs its parts named"}, "{category} needs its order"),
    reasons=({"complete": "[{opinion}] points are missing"}, "[{opinion}] check the order"),
    extensions=LEX,
)
FOCUS = {"LIC": "grant, notice", "ENG": "terms"}
REFERENCES = (Entry("STD-1", keywords=("license",)), Entry("STD-2", keywords=("tion", "GER")))


def sql_case(column: str, table: dict[str, str], default: str) -> str:
    """A CASE over a table of texts; templates hold SQL expressions in braces."""
    quoted = lambda t: "concat('" + t.replace("{", "', ").replace("}", ", '") + "')"
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {quoted(default)} END"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def lex_values(lexicon=LEX) -> str:
    """The lexicon as a DuckDB VALUES list: ordinal, code, weight, keywords."""
    return ", ".join(f"({i}, '{e.code}', {e.weight}, {sql_list(e.keywords)})" for i, e in enumerate(lexicon))


def family_values(lexicon=FAMILIES) -> str:
    return ", ".join(f"({i}, '{e.code}', '{e.pattern}')" for i, e in enumerate(lexicon))
