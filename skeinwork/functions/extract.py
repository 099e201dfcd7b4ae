"""Who, what and how much a story tells, and the keys by which stories are told apart.

A story is read as words. Names are runs of capitalised words; what they do follows from the
words beside them, which are looked up in sets. One Arrow-batched pass gives all facts of a kind.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions.text import col, without_labels

#: Names that name nobody.
NOBODY = ("the", "a", "an", "startup", "company", "firm", "plan", "plans")
#: What raising money is called, and how the scale of an amount is written.
RAISES = ("raise", "raises", "raised", "land", "lands", "landed", "secure", "secures", "secured", "bag", "bags", "bagged")
SCALES = {"million": "m", "billion": "b", "mn": "m", "mm": "m", "bn": "b", "m": "m", "b": "b"}
ROUNDS = ("pre-seed", "seed round", "seed", "series a", "series b", "series c", "series d", "series e", "series f")
INVESTS = ("led by", "from", "backed by", "with participation from")
#: Partnerships.
PARTNERSHIP = ("partnership", "collaboration", "partner", "partners", "partnered", "partnering")
PARTNERS_WITH = ("partners with", "partnered with", "partnering with", "collaborates with", "collaborated with", "collaborating with")
ENTERS = ("enter", "enters", "entered", "expand", "expands", "expanded", "expanding")
#: Launches, what a product is called and what names none by itself.
LAUNCHES = ("launches", "launched", "unveils", "unveiled", "introduces", "introduced", "releases", "released", "updates", "updated", "rolls out", "rolled out", "debuts", "debuted")
PRODUCTS = ("platform", "tool", "software", "system", "assistant", "controller", "family", "cobot", "robot")
PLURALS = ("platforms", "tools", "systems", "robots", "cobots")
ENDS_PRODUCT = ("to", "for", "with", "across", "on", "into", "targeting")
#: Deployments and the machines that are deployed.
DEPLOYS = ("deploy", "deploys", "deployed", "deploying", "deployment", "install", "installs", "installed", "installation", "rollout", "roll out", "rolling out", "pilot")
PLANS, CONFIRMS = ("plan to", "plans to", "planned to"), ("confirm", "confirms", "confirmed", "announce", "announces", "announced")
MACHINES = ("humanoid", "humanoids", "robot", "robots", "robot system", "robot systems")
#: Stories of a valuation, of a component, of a data factory; phrases that tease, terms that matter.
VALUATION = ("valuation", "valued at", "targets", "targeting", "next funding round", "completed financing", "series b+")
COMPONENTS = {
    "robotic_hand": ("robotic hand", "robotic hands", "robot hand", "robot hands", "humanoid hand", "humanoid hands", "dexterous hand", "dexterous hands", "robotic hand maker", "dexterous robotic systems"),
    "gripper": ("gripper", "grippers", "end-effector", "end-effectors", "end effector", "end effectors"),
}
DATA_FACTORY = ("data factory", "robot data factory", "real-world data", "real world data")
HEADQUARTERS = ("headquarters", "hq", "watertown")
TEASERS = ("the founders behind", "want to hire", "from sci-fi to reality", "here's why", "here is why", "how ", "why ")
INDUSTRIAL = ("construction", "robotics", "robotic", "industrial", "manufacturing", "factory", "jobsite", "worksite", "automation")
NAMES_PARTNERSHIP = ("partnership", "partners with", "partnered with", "collaboration")
NAMES_LAUNCH = ("launches", "launched", "updates", "updated", "introduces", "released")

_SIGNS = re.compile(r"([^A-Za-z0-9]*)(.*?)([^A-Za-z0-9]*)", re.S)
_CAPITAL, _PLAIN, _CAPITAL_OR_DIGIT = re.compile(r"[A-Z][A-Za-z0-9&./\-]*"), re.compile(r"[A-Z][A-Za-z0-9&\-]*"), re.compile(r"[A-Z0-9][A-Za-z0-9&/\-]*")
_MONEY = re.compile(r"([$€£])\s?(\d+(?:\.\d+)?)(\s?)(\w*)")
_WORDS = re.compile(r"\S+")
_COUNT = re.compile(r"\d{1,3}(?:,\d{3})+|\d+")


@lru_cache(256)
def _by_first_word(phrases: tuple[str, ...]) -> dict[str, list[list[str]]]:
    out: dict[str, list[list[str]]] = {}
    for p in phrases:
        out.setdefault(p.split(" ")[0], []).append(p.split(" "))
    return out


@lru_cache(1 << 16)
def _signed(word: str) -> tuple[str, str, str, str]:
    """The signs before a word, the word, those after it, and the word in lower case; most words come again."""
    before, core, after = _SIGNS.fullmatch(word).groups()
    for owned in ("'s", "’s"):
        if core.endswith(owned):
            core, after = core[:-2], owned + after
    return before, core, after, core.lower()


@dataclass(slots=True)
class Word:
    """A word with the signs before and after it."""

    before: str
    core: str
    after: str
    start: int
    low: str


class Story:
    """A text as words."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.words: list[Word] = []
        for m in _WORDS.finditer(self.text):
            word = m[0]
            if word.isascii() and word.isalnum():  # most words have no signs
                self.words.append(Word("", word, "", m.start(), word.lower()))
                continue
            before, core, after, low = _signed(word)
            self.words.append(Word(before, core, after, m.start() + len(before), low))

    def flows(self, i: int, like: re.Pattern | None = None) -> bool:
        """Whether word i follows the one before it without a sign between; a full stop is one only in plain names."""
        if not 0 < i < len(self.words) or self.words[i].before:
            return False
        after = self.words[i - 1].after
        return not after or not after.strip("-" if like is _PLAIN else ".-")

    def phrase(self, i: int, phrases: Sequence[str], exact: bool = False) -> int | None:
        """Where a phrase of the set that begins at word i ends; the longest one."""
        if i >= len(self.words):
            return None
        word, best = self.words[i], None
        for parts in _by_first_word(tuple(phrases)).get(word.core if exact else word.low, ()):
            end = i + len(parts)
            if end > (best or 0) and end <= len(self.words) and all((w.core if exact else w.low) == parts[k - i] and self.flows(k) for k, w in enumerate(self.words[i + 1 : end], i + 1)):
                best = end
        return best

    def starts(self, phrases: Sequence[str], exact: bool = False) -> list[int]:
        """Where a word stands that a phrase of the set begins with."""
        first = _by_first_word(tuple(phrases))
        return [i for i, w in enumerate(self.words) if (w.core if exact else w.low) in first]

    def passed(self, i: int, phrases: Sequence[str]) -> int:
        """i, beyond a phrase of the set if one stands there."""
        return self.does(i, phrases) or i

    def does(self, i: int, phrases: Sequence[str], exact: bool = False) -> int | None:
        if not 0 < i < len(self.words):
            return None
        word = self.words[i]
        return self.phrase(i, phrases, exact) if (word.core if exact else word.low) in _by_first_word(tuple(phrases)) and self.flows(i) else None

    def name(self, i: int, most: int = 4, like: re.Pattern = _CAPITAL) -> int:
        """Where the name that begins at word i ends; i if none does."""
        end = i
        while end < len(self.words) and end - i < most and like.fullmatch(self.words[end].core) and (end == i or self.flows(end, like)):
            end += 1
        return end

    def leading(self, most: int = 4) -> Iterator[int]:
        """Ends of the names that the text begins with, the longest first: a verb may be capitalised too."""
        if self.words and not self.words[0].before:
            yield from range(self.name(0, most), 0, -1)

    def names(self, like: re.Pattern = _CAPITAL) -> Iterator[tuple[int, int]]:
        """Runs of capitalised words, whole."""
        i = 0
        while i < len(self.words):
            end = self.name(i, len(self.words), like)
            if end > i:
                yield i, end
            i = max(end, i + 1)

    def said(self, i: int, end: int) -> str:
        return " ".join(w.core for w in self.words[i:end])


def named(raw: str) -> str | None:
    """A name in lower case with single blanks; null if it names nobody."""
    name = " ".join(re.findall("[a-z0-9]+", raw.lower()))
    return name if name and name not in NOBODY else None


def _only(values: list) -> object | None:
    """The one distinct value; null if there are none or several."""
    return values[0] if values and all(v == values[0] for v in values) else None


def _raises_at(s: Story, i: int) -> bool:
    return s.does(s.passed(s.passed(i, ("has",)), ("just",)), RAISES) is not None


def raiser(s: Story, possessive: bool = False) -> str | None:
    """Who raises money: the headline's first name, a name with an apposition, `startup X`, `X's`."""
    for end in s.leading():
        if _raises_at(s, end) and named(s.said(0, end)):
            return named(s.said(0, end))
    for i, end in s.names():
        if s.words[end - 1].after == "," and s.phrase(end, ("a", "an", "the"), exact=True):
            limit = s.words[end].start + 140
            for k in range(end + 2, len(s.words)):
                if s.words[k].start > limit or "." in s.words[k - 1].after + s.words[k - 1].core:
                    break
                if _raises_at(s, k) and named(s.said(max(i, end - 4), end)):
                    return named(s.said(max(i, end - 4), end))
    for k in range(1, len(s.words)):
        if s.words[k - 1].core in ("startup", "company", "firm") and s.flows(k) and named(s.said(k, s.name(k))):
            return named(s.said(k, s.name(k)))
    if possessive:
        for i, end in s.names():
            if s.words[end - 1].after.startswith("'s") and named(s.said(max(i, end - 4), end)):
                return named(s.said(max(i, end - 4), end))
    return None


def money(s: Story, signs: str = "$€£") -> tuple[str, str, str] | None:
    """Currency, value and scale of the first amount after a funding verb, else of the last one."""
    found = []
    for m in _MONEY.finditer(s.text):
        scale = SCALES.get(m[4].lower())
        if m[1] in signs and (scale or m[3] or not m[4]):
            found.append((m.start(), (m[1], format(Decimal(m[2]).normalize(), "f"), scale or "")))
    verb = next((w.start for w in s.words if w.low in RAISES), None)
    later = [a for at, a in found if verb is not None and at > verb]
    return later[0] if later else found[-1][1] if found else None


def round_of(s: Story) -> str | None:
    ends = ((i, s.phrase(i, ROUNDS)) for i in s.starts(ROUNDS))
    return next((s.said(i, end).lower() for i, end in ends if end), None)


def backers(s: Story) -> list[str]:
    out = []
    for i in s.starts(INVESTS, exact=True):
        end = s.phrase(i, INVESTS, exact=True)
        if end and s.flows(end) and (name := named(s.said(end, s.name(end)))) and name not in out:
            out.append(name)
    return out


def valuation_story(s: Story) -> bool:
    low = s.text.lower()
    return any(t in low for t in VALUATION)


def component(s: Story) -> str | None:
    return next((c for c, phrases in COMPONENTS.items() if any(s.phrase(i, phrases) for i in s.starts(phrases))), None)


def _pair(left: str, right: str) -> list[list[str]]:
    a, b = named(left), named(right)
    return [sorted((a, b))] if a and b and a != b else []


def _joined(s: Story, like: re.Pattern = _CAPITAL) -> Iterator[tuple[int, int, int]]:
    """Where names that `and` joins begin, are joined and end."""
    ands = [k for k in range(1, len(s.words) - 1) if s.words[k].core == "and" and s.flows(k, like) and s.flows(k + 1, like)]
    ends = {end: i for i, end in s.names(like)} if ands else {}
    for k in ands:
        if k in ends:
            for end in range(s.name(k + 1, 4, like), k + 1, -1):
                yield max(ends[k], k - 4), k, end


def partners(s: Story) -> list[str] | None:
    """The one unordered pair that the text says partner up; names without full stops."""
    found = []
    for first, both, last in _joined(s, _PLAIN):
        i = s.passed(last, ("is", "are"))
        entered = s.passed(i, ENTERS)
        i = s.passed(entered, ("their", "a")) if entered > i else i
        if s.does(s.passed(i, ("strategic", "global", "broader")), PARTNERSHIP):
            found += _pair(s.said(first, both), s.said(both + 1, last))
    for i, last in s.names(_PLAIN):
        for end in range(last, i, -1):
            other = s.does(end, PARTNERS_WITH)
            if other and s.flows(other, _PLAIN):
                found += _pair(s.said(max(i, end - 4), end), s.said(other, s.name(other, 4, _PLAIN)))
    return _only(found)


def _launch(title: Story) -> tuple[str, int] | None:
    found = ((end, title.does(end, LAUNCHES)) for end in title.leading())
    return next(((title.said(0, end), verb) for end, verb in found if verb), None)


def launcher(title: Story) -> str | None:
    found = _launch(title)
    return named(found[0]) if found else None


def _product(raw: str) -> str | None:
    clean = re.sub(r"[^a-z0-9&/\-\s]+", " ", re.sub("[‐-―]", "-", raw.strip()).lower())
    clean = " ".join(clean.split()).strip(" -/")
    return clean if clean not in (*PRODUCTS, *PLURALS) and set(re.findall(r"[a-z0-9]+", clean)) & set(PRODUCTS) else None


def product(title: Story, preview: Story) -> str | None:
    """The one product that the preview names, else that of the title."""
    found = []
    for i in range(len(preview.words)):
        its, called = preview.phrase(i, ("its",)), preview.phrase(i, ("called",))
        if its:
            at = preview.passed(its, ("new", "latest"))
            end = preview.name(at, 5, _CAPITAL_OR_DIGIT) if preview.flows(at) else at
            noun = preview.does(end, ("cobot family", *PRODUCTS)) if end > at else None
            if noun or (end > at + 1 and preview.phrase(end - 1, PRODUCTS)):
                found.append(_product(preview.said(at, noun or end)))
        if called:
            at = preview.passed(called, ("the",))
            end = preview.name(at, 5, _CAPITAL_OR_DIGIT) if preview.flows(at) else at
            if end > at:
                found.append(_product(preview.said(at, end)))
    found = [p for p in found if p]
    launch = _launch(title)
    if _only(found) or not launch:
        return _only(found)
    end = at = launch[1]
    while end < len(title.words) and title.flows(end) and title.words[end].core not in ENDS_PRODUCT:
        end += 1
    shut = end < len(title.words) and not title.flows(end)
    return _product(title.said(at, end)) if end > at and not shut and not title.words[end - 1].after.strip(".-!?") else None


def deployers(s: Story) -> list[str] | None:
    found = []
    for first, both, last in _joined(s):
        if s.does(s.passed(s.passed(last, ("to",)), PLANS), DEPLOYS):
            found += _pair(s.said(first, both), s.said(both + 1, last))
    return _only(found)


def deployer_of(title: Story) -> str | None:
    for end in title.leading():
        i = title.passed(title.passed(title.passed(end, PLANS), CONFIRMS), ("the",))
        if title.does(i, DEPLOYS):
            return named(title.said(0, end))
    return None


def machines(s: Story) -> str | None:
    """How many machines are told of: the first number that up to three names and a machine follow."""
    for i, w in enumerate(s.words):
        if w.core[:1].isdigit() and _COUNT.fullmatch(w.core) and not w.after and s.flows(i + 1):
            for names in range(4):
                if s.name(i + 1, names) == i + 1 + names and s.does(i + 1 + names, MACHINES, exact=True):
                    return w.core.replace(",", "")
    return None


def programme(s: Story) -> str | None:
    """The one branded machine that the text names."""
    found = []
    for i in s.starts(MACHINES, exact=True):
        end = s.does(i, MACHINES, exact=True)
        first = i
        while end and first > 0 and i - first < 3 and _CAPITAL_OR_DIGIT.fullmatch(s.words[first - 1].core) and (first == i or s.flows(first)):
            first -= 1
        while first < i and not s.words[first].core[0].isupper():
            first += 1
        if end and first < i:
            found.append(s.said(first, end).lower())
    return _only(found)




def _mapped(reads: Callable[[Story], object], kind: str) -> Callable[..., Column]:
    def rows(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: reads(Story(t)))

    return F.pandas_udf(rows, kind)


def _of(reads: Callable[[Story], object], kind: str) -> Callable[[Column | str], Column]:
    return lambda text: _mapped(reads, kind)(col(text))


MONEY = "struct<currency:string,value:string,scale:string>"


def _as_money(found: tuple[str, str, str] | None) -> dict | None:
    return dict(zip(("currency", "value", "scale"), found)) if found else None


funding_entity = _of(raiser, "string")
round_marker = _of(round_of, "string")
investors = _of(backers, "array<string>")
partnership_pair = _of(partners, "array<string>")
launch_company = _of(launcher, "string")
deployment_pair = _of(deployers, "array<string>")
deployer = _of(deployer_of, "string")
quantity = _of(machines, "string")
program = _of(programme, "string")
component_category = _of(component, "string")


def entity(raw: Column | str) -> Column:
    """A name in lower case with single blanks; null if it names nobody."""
    name = F.trim(F.regexp_replace(F.lower(col(raw)), "[^a-z0-9]+", " "))
    return F.when((name != "") & ~name.isin(*NOBODY), name)


def _money_rows(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([money(Story(t)) or (None, None, None) for t in texts], columns=["currency", "value", "scale"], dtype=object)


def amount(text: Column | str) -> Column:
    """struct(currency, value, scale) of the amount that a story tells; null without one."""
    return _given(F.pandas_udf(_money_rows, MONEY)(col(text)), "currency")


def _given(facts: Column, *fields: str) -> Column:
    """facts, or null where one of these fields is; computed once."""

    def kept(k: Column) -> Column:
        there = k[fields[0]].isNotNull()
        for f in fields[1:]:
            there &= k[f].isNotNull()
        return F.when(there, k)

    return let(facts, kept)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def launch_key(title: Column | str, preview: Column | str) -> Column:
    """struct(company, product); null without either."""

    def rows(titles: pd.Series, previews: pd.Series) -> pd.DataFrame:
        pairs = [(Story(a), Story(b)) for a, b in zip(titles, previews)]
        return pd.DataFrame([(launcher(a), product(a, b)) for a, b in pairs], columns=["company", "product"], dtype=object)

    return _given(F.pandas_udf(rows, "struct<company:string,product:string>")(col(title), col(preview)), "company", "product")


def _facts(reads: Callable[..., dict | None], kind: str, made: pa.DataType) -> Callable[..., Column]:
    """A struct of what reads() finds in a row, null where it finds nothing; rows go from Arrow to Arrow."""

    def rows(*columns: pa.Array) -> pa.Array:
        return pa.array([reads(*row) for row in zip(*(c.to_pylist() for c in columns))], made)

    return F.arrow_udf(rows, kind)


_FUNDING = f"struct<entity:string,amount:{MONEY},round:string,investors:array<string>,valuation:boolean,component:string,published:date>"
_TEXT = pa.string()
_FUNDING_MADE = pa.struct({"entity": _TEXT, "amount": pa.struct({"currency": _TEXT, "value": _TEXT, "scale": _TEXT}), "round": _TEXT, "investors": pa.list_(_TEXT), "valuation": pa.bool_(), "component": _TEXT, "published": pa.date32()})
#: What a text has, of whatever case, that says who raises money (raiser), and that something is deployed (deployers, deployer_of).
_RAISING, _DEPLOYING = re.compile("rais|land|secur|bag|startup|company|firm|'s", re.I), re.compile("deploy|install|roll|pilot", re.I)


def _funding(possessive: bool, signs: str, priced: bool) -> Callable[..., dict | None]:
    """Reads what a funding story tells; nothing without who and when, and without an amount if it must be priced."""

    def reads(head: str | None, preview: str | None, day: date | None) -> dict | None:
        text = " ".join(x for x in (head, preview) if x)
        if day is None or (priced and not any(sign in text for sign in signs)) or not _RAISING.search(text):
            return None
        whole = Story(text)
        first = whole if not preview else Story(head)
        who = raiser(first) or (raiser(Story(preview)) if preview else None) or (raiser(whole, possessive) if preview or possessive else None)
        much = money(whole, signs) if who else None
        if not who or (priced and not much):
            return None
        return {"entity": who, "amount": _as_money(much), "round": round_of(whole), "investors": backers(whole), "valuation": valuation_story(whole), "component": component(whole), "published": day}

    return reads


def funding_key(title: Column | str, preview: Column | str, published: Column | str, signs: str = "$€£") -> Column:
    """What a funding story tells; null where entity, amount or date is missing."""
    return _facts(_funding(False, signs, True), _FUNDING, _FUNDING_MADE)(without_labels(title), F.coalesce(col(preview), F.lit("")), F.to_date(col(published)))


def run_funding(title: Column | str, preview: Column | str, published: Column | str) -> Column:
    """The same within a run: `X's` names who raises too, and an amount may be missing."""
    return _facts(_funding(True, "$€£", False), _FUNDING, _FUNDING_MADE)(without_labels(title), F.coalesce(col(preview), F.lit("")), F.to_date(col(published)))


_DEPLOYMENT = "struct<pair:array<string>,entity:string,quantity:string,product:string,published:date>"
_DEPLOYMENT_MADE = pa.struct({"pair": pa.list_(_TEXT), "entity": _TEXT, "quantity": _TEXT, "product": _TEXT, "published": pa.date32()})


def _deployment(title: str | None, preview: str | None, day: date | None) -> dict | None:
    text = " ".join(x for x in (title, preview) if x)
    if day is None or not _DEPLOYING.search(text):
        return None
    whole = Story(text)
    who, what = deployer_of(Story(title) if preview else whole), programme(whole)
    brand, _, kind = (what or "").partition(" ")
    pair = deployers(whole) or (sorted((who, brand)) if who and kind and named(brand) and who != brand else None)
    if pair and brand in pair and kind in MACHINES:  # a maker's machines are no programme of their own
        what = None
    many = machines(whole)
    enough = (pair or who is not None) and (many is not None or what is not None) and (pair or what is not None)
    return {"pair": pair, "entity": who, "quantity": many, "product": what, "published": day} if enough else None


def deployment_key(title: Column | str, preview: Column | str, published: Column | str) -> Column:
    """struct(pair, entity, quantity, product, published); null where it would name too little."""
    return _facts(_deployment, _DEPLOYMENT, _DEPLOYMENT_MADE)(col(title), col(preview), F.to_date(col(published)))


def same_funding(a: Column, b: Column, days: int = 3) -> Column:
    """Whether two funding keys tell of one event: the same amount and round (null rounds are
    equal), or two valuations in billions of one kind of component maker."""
    component_ = a["valuation"] & b["valuation"] & (a["component"] == b["component"]) & (a["amount"]["scale"] == "b") & (b["amount"]["scale"] == "b")
    told = (a["amount"] == b["amount"]) & a["round"].eqNullSafe(b["round"])
    return (a["entity"] == b["entity"]) & (F.abs(F.datediff(a["published"], b["published"])) <= days) & (F.coalesce(component_, F.lit(False)) | told)


def same_run_funding(a: Column, b: Column, days: int = 3) -> Column:
    """Within a run: the same amount; or the same round and a shared investor, where an amount is missing."""
    backed = a["amount"].isNull() | b["amount"].isNull()
    backed &= (a["round"] == b["round"]) & F.arrays_overlap(a["investors"], b["investors"])
    return (a["entity"] == b["entity"]) & (F.abs(F.datediff(a["published"], b["published"])) <= days) & (F.coalesce(a["amount"] == b["amount"], F.lit(False)) | F.coalesce(backed, F.lit(False)))


def same_deployment(a: Column, b: Column, days: int = 7) -> Column:
    """Whether two deployment keys tell of one event; a single name must be one of the pair."""
    who = (
        F.when(a["pair"].isNotNull() & b["pair"].isNotNull(), a["pair"] == b["pair"])
        .when(a["pair"].isNotNull(), F.array_contains(a["pair"], b["entity"]))
        .when(b["pair"].isNotNull(), F.array_contains(b["pair"], a["entity"]))
        .otherwise(a["entity"] == b["entity"])
    )
    product_ = a["product"].isNull() | b["product"].isNull() | (a["product"] == b["product"])
    return F.coalesce(who, F.lit(False)) & product_ & a["quantity"].eqNullSafe(b["quantity"]) & (F.abs(F.datediff(a["published"], b["published"])) <= days)


def _any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out |= F.contains(text, F.lit(t))
    return out


def industrial(text: Column | str) -> Column:
    return _any(F.lower(col(text)), INDUSTRIAL)


def repeat_key(title: Column | str, preview: Column | str, signalled: Column) -> Column:
    """struct(company, angle) of a story that is told again and again; null for all others.

    signalled: whether a flag says that the story is about a plant, a robot or a launch.
    """
    text = F.concat_ws(" ", col(title), col(preview))
    low = F.lower(text)
    company = F.coalesce(launch_company(title), _mapped(lambda s: raiser(s, True), "string")(text))
    told = _any(low, DATA_FACTORY) & (F.coalesce(signalled, F.lit(False)) | _any(low, HEADQUARTERS))
    return F.when(told & company.isNotNull(), F.struct(company.alias("company"), F.lit("robot_data_factory").alias("angle")))


def framing(title: Column | str, kind: str) -> Column:
    """How directly a headline tells its event: 2 if it names who does what, 1 if it only has the words, one less if it teases."""
    low = F.lower(col(title))
    direct, words = {
        "funding": (lambda s: any(_raises_at(s, end) for end in s.leading()), RAISES),
        "partnership": (lambda s: partners(s) is not None, NAMES_PARTNERSHIP),
        "product": (lambda s: launcher(s) is not None, NAMES_LAUNCH),
    }[kind]
    named_ = _mapped(lambda s: bool(direct(s)), "boolean")(col(title))
    loose = F.exists(F.split(low, "[^a-z]+"), lambda w: w.isin(*words)) if kind == "funding" else _any(low, words)
    return F.when(named_, 2).when(loose, 1).otherwise(0) - F.when(_any(low, TEASERS), 1).otherwise(0)
