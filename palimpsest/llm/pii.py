"""Personal data by candidate gradient boosting, in DataFrame functions only.

Strict patterns with their checks give the base spans, which always stand.
Looser generators propose further spans: phone numbers without a plus, spelled
out addresses, address parts in brackets, cards of other lengths and groups.
Boosted trees score each by its format and by what stands around it, and those
above their kind's calibrated threshold are added where no base span is.

Nothing in a corpus says what is personal, so the trees learn from two weak
sources.  In a sample of the corpus, a candidate that a base span of its kind
overlaps is a positive; one that fails its kind's check, or overlaps a base span of
another kind only, is a negative; the rest has no label.  Beside it stand invented
sentences (``seeds``) with one number or address in each, personal or not, so
that every kind has both labels in forms that the base doesn't know.  The checks
themselves are no features.  A kind's threshold is set on the half that
the trees didn't see, among candidates without any base span, as only such are ever added.

Positions are code points.  SQL has no function for them, so a text is split at the
matches and the lengths are added up, in passes that each double the reach
(``scanned``), so that a text with very many matches takes n log n steps.  The
patterns are possessive where that changes nothing, as a repeated group in Java's
engine otherwise recurses once a character.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cleared, cut

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every match of a base pattern has; cheaper to test.
BASE_NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{4}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]"}
_AT, _DOT = r"(?:@|\x20?[({\[]at[)}\]]\x20?|\x20at\x20)", r"(?:\.|\x20?[({\[]dot[)}\]]\x20?|\x20dot\x20)"
GENERATORS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:{_AT}[A-Za-z0-9-]{{1,63}}+(?:\x20?[({{\[]dot[)}}\]]\x20?|\x20dot\x20)|(?:@|\x20?[({{\[]at[)}}\]]\x20?)[A-Za-z0-9-]{{1,63}}+\.)[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{0,5}}",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:(?:\.|[\[(]\.[\])])[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4}){0,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\+|\(|\+\()?[0-9](?:[().\x20/-]{0,3}[0-9]){6,14}(?![0-9A-Za-z]|[.-][0-9])",
}
#: The same for the generators.
NEEDED = {"email": r"@|[({\[]at[)}\]]|\x20dot\x20", "ip": r"[0-9][\])]?\.[\[(]?[0-9]|[\[(]\.[\])]|[0-9A-Fa-f]::?[0-9A-Fa-f]", "card": r"[0-9]{4}|[0-9][\x20.-][0-9]", "phone": r"[0-9]{3}|[0-9][().\x20/-][0-9]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IN_RANGE = rf"\A{OCTET}(?:\.{OCTET}){{3}}\z"
#: Words before a candidate that speak for its kind.
CONTEXT = {
    "email": "(?i)mail|contact|write|reach|kontakt|schreib|correo|courriel",
    "ip": r"(?i)\bip|host|server|address|addr|login|client|adresse",
    "card": "(?i)card|visa|master|amex|pay|carte|karte|tarjeta|debit|credit",
    "phone": r"(?i)phone|call|reach|number|tel\b|tel[.:]|telefon|fax|mobil|cell|whatsapp|anruf|appel|llam|sms|dial",
}
#: Words before a number that say that it's something else.
CONTRARY = r"(?i)order|invoice|total|version|page|isbn|serial|part|item|ticket|case|sum|amount|price|since|dated|\bid\b|\bno\b|\bnr\b|№|#|[$€£]"
FEATURES = ("kind", "length", "digits", "groups", "first", "last", "longest", "zero", "varied", "dots", "dashes", "spaces", "brackets", "colons", "letters", "year", "cue", "contrary", "before", "after")

_SPANS = "array<struct<a:int,z:int,m:string>>"
_CANDIDATES = "array<struct<kind:int,a:int,z:int,fails:boolean," + ",".join(f"f_{f}:int" for f in FEATURES) + ",own:boolean,other:boolean>>"


def _nothing(kind: str = _SPANS) -> Column:
    return F.array().cast(kind)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each element combined with all before it, for a ``let`` variable; log n passes, of which each reaches twice as far.

    ``combine`` gets null for what would be before the first.
    """
    steps = F.filter(F.lit([1 << k for k in range(28)]), lambda s: s < F.size(values))
    return F.aggregate(steps, values, lambda so_far, s: F.transform(so_far, lambda x, i: combine(x, F.get(so_far, i - s))))


def places(text: Column, pattern: str) -> Column:
    """Start, end and text of each match, and a little of what is before and after; leftmost first, none overlapping."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))

    def spans(x: Column) -> Column:
        n = F.size(x["m"])
        sides = F.zip_with(F.slice(x["gaps"], F.lit(1), n), F.slice(x["gaps"], F.lit(2), n), lambda b, a: F.struct(F.length(b).alias("gap"), F.right(b, F.lit(24)).alias("left"), F.left(a, F.lit(2)).alias("right")))
        parts = F.zip_with(sides, x["m"], lambda s, m: F.struct((s["gap"] + F.length(m)).alias("n"), m.alias("m"), s["left"].alias("left"), s["right"].alias("right")))
        ends = lambda p: let(p["n"], lambda v: scanned(v, lambda y, before: y + F.coalesce(before, F.lit(0))))
        return let(parts, lambda p: F.zip_with(ends(p), p, lambda z, y: F.struct((z - F.length(y["m"])).alias("a"), z.alias("z"), y["m"].alias("m"), y["left"].alias("left"), y["right"].alias("right"))))

    return let(both, spans)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _checked(kind: str, m: Column) -> Column:
    """Whether a match of the kind passes its checks."""
    if kind == "ip":
        return m.rlike(IN_RANGE)
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    spans = F.transform(F.filter(places(text, BASE[kind]), lambda s: _checked(kind, s["m"])), lambda s: F.struct(s["a"].alias("a"), s["z"].alias("z"), s["m"].alias("m")))
    return F.when(text.rlike(BASE_NEEDED[kind]), spans).otherwise(_nothing())


def _proposed(text: Column, kind: str) -> Column:
    """Candidates of a kind with their features."""
    count = lambda m, characters: F.length(m) - F.length(F.translate(m, characters, ""))
    is_ = lambda x: F.coalesce(x, F.lit(False)).cast("int")

    def one(c: Column) -> Column:
        m, digits = c["m"], _digits(c["m"])
        runs = F.regexp_extract_all(m, F.lit("[0-9A-Fa-f]+" if kind == "ip" else "[0-9]+"), F.lit(0))
        lengths = F.transform(runs, F.length)
        fails = {"ip": F.lit(False) if kind != "ip" else ~F.regexp_replace(m, r"[\[\]()]", "").rlike(IN_RANGE) & ~m.contains(":"), "card": ~F.call_function("luhn_check", digits)}.get(kind, F.lit(False))
        none = F.lit(0)
        values = {
            "kind": F.lit(KINDS.index(kind)),
            "length": F.length(m),
            "digits": F.length(digits),
            "groups": F.size(runs),
            "first": F.coalesce(F.get(lengths, F.lit(0)), none),
            "last": F.coalesce(F.get(lengths, F.size(runs) - 1), none),
            "longest": F.coalesce(F.array_max(lengths), none),
            "zero": is_(digits.startswith("0")),
            "varied": F.size(F.array_distinct(F.split(digits, ""))),
            "dots": count(m, "."),
            "dashes": count(m, "-/"),
            "spaces": count(m, " "),
            "brackets": count(m, "([{"),
            "colons": count(m, ":"),
            "letters": F.length(F.regexp_extract(m, r"[A-Za-z]*\z", 0)),
            "year": is_(m.rlike(r"(?:\A|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|\z)")),
            "cue": is_(c["left"].rlike(CONTEXT[kind])),
            "contrary": is_(c["left"].rlike(CONTRARY)),
            "before": F.when(c["left"].rlike(r"\s\z") | (c["left"] == ""), 0).when(c["left"].rlike(r"[:(\[<\"']\z"), 1).otherwise(2),
            "after": F.when(c["right"].rlike(r"\A\s") | (c["right"] == ""), 0).when(c["right"].rlike(r"\A[.,;:!?)\]>\"']"), 1).otherwise(2),
        }
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), c["a"].alias("a"), c["z"].alias("z"), F.coalesce(fails, F.lit(False)).alias("fails"), *[values[f].cast("int").alias(f"f_{f}") for f in FEATURES])

    empty = _CANDIDATES.replace(",own:boolean,other:boolean", "")
    return F.when(text.rlike(NEEDED[kind]), F.transform(places(text, GENERATORS[kind]), one)).otherwise(_nothing(empty))


def _marked(base: dict[str, Column], found: Column) -> Column:
    """Candidates with ``own`` and ``other``: whether a base span of their kind, or of another, overlaps them.

    All spans are sorted once; the furthest end of each kind's base spans so far, and from
    the other side the nearest start, tell what overlaps.
    """
    number = range(len(KINDS))

    def events(c: Column) -> Column:
        own = [F.transform(base[k], lambda s, i=i: F.struct(s["a"].alias("a"), s["z"].alias("z"), F.lit(i).alias("kind"), F.lit(-1).alias("at"))) for i, k in enumerate(KINDS)]
        return F.sort_array(F.concat(*own, F.transform(c, lambda x, i: F.struct(x["a"].alias("a"), x["z"].alias("z"), x["kind"].alias("kind"), i.alias("at")))))

    def of_base(e: Column, end: str) -> Column:
        return F.transform(e, lambda x: F.struct(*[F.when((x["at"] < 0) & (x["kind"] == i), x[end]).alias(f"k{i}") for i in number]))

    def reach(best) -> Callable[[Column], Column]:
        return lambda v: scanned(v, lambda x, before: F.struct(*[best(x[f"k{i}"], before[f"k{i}"]).alias(f"k{i}") for i in number]))

    def marks(e: Column) -> Column:
        before = let(of_base(e, "z"), reach(F.greatest))
        after = F.reverse(let(F.reverse(of_base(e, "a")), reach(F.least)))
        around = F.zip_with(before, after, lambda b, f: F.struct(b.alias("b"), f.alias("f")))

        def one(x: Column, s: Column) -> Column:
            hit = [F.coalesce(s["b"][f"k{i}"] > x["a"], F.lit(False)) | F.coalesce(s["f"][f"k{i}"] < x["z"], F.lit(False)) for i in number]
            own = other = F.lit(False)
            for i in number:
                own, other = own | ((x["kind"] == i) & hit[i]), other | ((x["kind"] != i) & hit[i])
            return F.struct(x["at"].alias("at"), own.alias("own"), other.alias("other"))

        return F.sort_array(F.filter(F.zip_with(e, around, one), lambda x: x["at"] >= 0))

    names = _CANDIDATES.split("<", 2)[2].split(",own")[0].split(",")
    kept = [n.split(":")[0] for n in names]
    joined = lambda c: let(events(c), lambda e: F.zip_with(c, marks(e), lambda x, y: F.struct(*[x[n].alias(n) for n in kept], y["own"].alias("own"), y["other"].alias("other"))))
    return let(found, lambda c: F.when(F.size(c) > 0, joined(c)).otherwise(_nothing(_CANDIDATES)))


@functools.cache
def _columns(jvm: int) -> dict[str, Column]:
    """What ``candidates`` adds; built once for each JVM, as building takes longer than planning."""
    text = F.col("pii_text")
    found = F.concat(*[_proposed(text, k) for k in KINDS])
    return {f"base_{k}": base_spans(text, k) for k in KINDS} | {"pii_candidates": _marked({k: F.col(f"base_{k}") for k in KINDS}, found)}


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with pii_text, base_<kind> and pii_candidates."""
    rows = docs.withColumn("pii_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    for name, column in _columns(id(docs.sparkSession._jvm)).items():
        rows = rows.withColumn(name, column)
    return rows


# ---- what the trees learn from


def _luhn(digits: list[int]) -> list[int]:
    """The digits with the last one set so that the sum is right."""
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits[:-1])))
    return [*digits[:-1], -total % 10]


def _filled(form: str, rng: random.Random) -> str:
    """A form with its marks filled in: # a digit, @ a word, & a short one, % an octet, x a hexadecimal digit."""
    word = lambda n: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(n))
    fill = {"#": lambda: str(rng.randrange(10)), "@": lambda: word(rng.randrange(4, 9)), "&": lambda: rng.choice(["com", "org", "net", "de", "fr", "es", "io"]), "%": lambda: str(rng.randrange(256)), "x": lambda: rng.choice("0123456789abcdef")}
    return "".join(fill[c]() if c in fill else c for c in form)


#: Forms of each kind, and of what looks like one; x stands for a hexadecimal digit.
PERSONAL = {
    "phone": ["(###) ###-####", "(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "+## ## ## ## ## ##", "+# (###) ###-####", "0# ## ## ## ##", "0### ######", "0##/#######", "0### ### ###", "(0##) ####-####", "0#########"],
    "email": ["@ (at) @ (dot) &", "@.@ [at] @ [dot] &", "@(at)@.&", "@[at]@.&", "@ at @ dot &", "@{at}@{dot}&", "@.@ (at) @.&"],
    "ip": ["%[.]%[.]%[.]%", "%.%.%[.]%", "%(.)%(.)%(.)%", "xxxx:xxxx:xxx:x:x:xxxx:xxxx:xxxx", "xxxx:xxx::x:xxxx", "fe80::xxxx:xxxx:xxxx"],
    "card": ["4###.####.####.####", "5### #### #### ####", "34## ###### #####", "37## ###### #####", "37#############", "36##-######-####"],
}
OTHERS = ["20##-0#-1#", "1#.0#.20##", "19##-20##", "20## 0# 1# 1#", "### ### ###", "# ### ###", "#####-####", "978-#-###-#####-#", "978-##-####-##-#", "1##.##.###.##", "#.##.###.#", "##:##:##:##", "xx:xx:xx:xx:xx:xx", "##############", "#############", "#### #### #### ####", "####-###-###", "## ## ## ##", "#######", "########", "#########", "##########", "##/##/20##", "###.###.###", "(20##) ##-###", "@ at @ dot @", "@ at @ dot @", "@ (at) @ (dot) @"]
SAID = {
    "phone": ["call {}", "phone: {}", "Tel. {}", "tel: {}", "Telefon {}", "mobile {}", "fax {}", "appelez le {}", "llame al {}"],
    "email": ["mail {}", "write to {}", "contact: {}", "Kontakt {}", "correo {}", "reach me: {}", "e-mail ({})", "{}"],
    "ip": ["host {}", "server {}", "ip: {}", "login from {}", "address {}", "client {}", "{}"],
    "card": ["card {}", "paid with visa {}", "amex {}", "Karte {}", "carte: {}", "credit card no. {}"],
}
OTHERWISE = ["order {}", "invoice no. {}", "total {}", "version {}", "page {}", "isbn {}", "serial {}", "item #{}", "ticket {}", "since {}", "dated {}", "id {}", "{}", "{}", "about {} of them", "and {} more"]


def seeds(each: int = 400, seed: int = 11) -> list[tuple[str, int]]:
    """(sentence, kind or -1): invented sentences with one thing in each, ``each`` of a kind and twice as many of none."""
    rng, out = random.Random(seed), []
    filler = lambda: " ".join(_filled("@", rng) for _ in range(rng.randrange(2, 6)))

    def said(thing: str, ways: list[str]) -> str:
        return f"{filler()} {rng.choice(ways).format(thing)}{rng.choice(['', '', '.', ',', ';'])} {filler()}"

    for number, kind in enumerate(KINDS):
        for i in range(each):
            form = PERSONAL[kind][i % len(PERSONAL[kind])]
            thing = _filled(form, rng)
            if kind == "card":
                right = iter(_luhn([int(c) for c in thing if c.isdigit()]))
                thing = "".join(str(next(right)) if c.isdigit() else c for c in thing)
            # What has a telling form needs no word before it.
            plain = form.startswith(("(###)", "###-", "+", "xx", "fe", "4#", "5#")) and rng.random() < 0.5
            out.append((said(thing, ["{}"] if plain else SAID[kind]), number))
    return out + [(said(_filled(OTHERS[i % len(OTHERS)], rng), OTHERWISE), -1) for i in range(2 * each * len(KINDS))]


@dataclass
class Trees:
    """Depth-two trees: (feature, cut, ((feature, cut, low, high), (feature, cut, low, high))), and a threshold for each kind."""

    trees: list
    start: float
    thresholds: dict[str, float]

    def score(self, c: str) -> str:
        """SQL of the score of a candidate called ``c``."""
        total = [f"{self.start!r}D"]
        for feature, at, sides in self.trees:
            leaf = [f"CASE WHEN {c}.f_{f} <= {t!r}D THEN {low!r}D ELSE {high!r}D END" for f, t, low, high in sides]
            total.append(f"CASE WHEN {c}.f_{feature} <= {at!r}D THEN {leaf[0]} ELSE {leaf[1]} END")
        return f"(1 / (1 + exp(-aggregate(array({', '.join(total)}), 0D, (x, y) -> x + y))))"


def _split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0):
    """The feature and cut of the largest gain, and the gain."""
    best = (0.0, 0, float("inf"))
    whole = grad.sum() ** 2 / (hess.sum() + ridge)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, g, h = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
        ends = np.flatnonzero(values[1:] != values[:-1])
        if len(ends):
            gain = g[ends] ** 2 / (h[ends] + ridge) + (g[-1] - g[ends]) ** 2 / (h[-1] - h[ends] + ridge) - whole
            if gain.max() > best[0] + 1e-9:
                i = ends[gain.argmax()]
                best = (float(gain.max()), f, float(values[i] + values[i + 1]) / 2)
    return best


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3) -> tuple[list, float, np.ndarray]:
    """Trees, starting value and the sums they give to ``x`` (logistic loss, Newton steps)."""
    start = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    total, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        gain, f, at = _split(x, grad, hess)
        if gain <= 0:
            break
        sides = []
        for part in (x[:, f] <= at, x[:, f] > at):
            _, g, cut_ = _split(x[part], grad[part], hess[part])
            leaves = []
            for leaf in (part & (x[:, g] <= cut_), part & (x[:, g] > cut_)):
                value = rate * grad[leaf].sum() / (hess[leaf].sum() + 1.0)
                total = total + value * leaf
                leaves.append(float(value))
            sides.append((FEATURES[g], cut_ if np.isfinite(cut_) else 1e9, *leaves))
        trees.append((FEATURES[f], at, tuple(sides)))
    return trees, start, total


def predict(trees: list, start: float, x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), start)
    col = {f: i for i, f in enumerate(FEATURES)}
    for f, at, sides in trees:
        values = [np.where(x[:, col[g]] <= cut_, low, high) for g, cut_, low, high in sides]
        total = total + np.where(x[:, col[f]] <= at, *values)
    return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 10_000, each: int = 8, precision: float = 0.95) -> Trees:
    """Trees from the candidates of about ``sample`` different texts, chosen by their hash, and from ``seeds``.

    A text gives at most ``each`` labelled candidates.  Half of the texts and
    seeds fit the trees, the other half sets each kind's threshold: the least,
    from 0.5 on, at which ``precision`` of what it lets through is right.  The sampled texts are written first, so
    that candidates are made of them alone.
    """
    count = docs.count()
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    some = docs.select(body.alias("t"), F.xxhash64(F.lit("pii"), body).alias("place"))
    share = min(1.0, sample / max(count, 1))
    some = some.where(F.pmod("place", F.lit(1 << 20)) < int((1 << 20) * share) + (count <= sample)) if share < 1 else some
    some = cut(some.groupBy("place").agg(F.min("t").alias("t")).withColumn("kind", F.lit(None).cast("int")))
    spark = docs.sparkSession
    told = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(seeds())], "place long, t string, kind int")
    rows = candidates(some.unionByName(told), "t")
    label = lambda c: F.when(F.col("kind").isNotNull(), (F.col("kind") == c["kind"]).cast("int")).when(c["own"], 1).when(c["other"] | c["fails"], 0)
    known = F.filter(F.transform("pii_candidates", lambda c: F.struct(label(c).alias("y"), (~c["own"] & ~c["other"]).cast("int").alias("open"), c.alias("c"))), lambda x: x["y"].isNotNull())
    half = F.pmod(F.xxhash64(F.lit("half"), "place"), F.lit(2)).alias("half")
    # An outer explode, as Spark would put a second copy of all patterns into a filter for an inner one.
    rows = rows.select(half, F.explode_outer(F.slice(known, 1, each)).alias("x")).where("x is not null")
    got = np.array([tuple(r) for r in rows.select("half", "x.y", "x.open", *[f"x.c.f_{f}" for f in FEATURES]).collect()], float).reshape(-1, 3 + len(FEATURES))
    got = got[np.lexsort(got.T)]  # the order of rows differs from run to run
    first, second = got[got[:, 0] == 0], got[(got[:, 0] == 1) & (got[:, 2] == 1)]
    trees, start, _ = boost(first[:, 3:], first[:, 1])
    scores, thresholds = predict(trees, start, second[:, 3:]), {}
    for number, kind in enumerate(KINDS):
        own = second[:, 3] == number
        order = np.argsort(-scores[own], kind="stable")
        y, s = second[own, 1][order], scores[own][order]
        right = np.cumsum(y) / np.arange(1, len(y) + 1)
        last = np.r_[s[1:] != s[:-1], True] if len(s) else np.zeros(0, bool)
        fine = np.flatnonzero((right >= precision) & last)
        thresholds[kind] = max(0.5, float(s[fine[-1]])) if len(fine) else 1.0
    return Trees(trees, start, thresholds)


def base_of(kind: str) -> Column:
    """The base spans of a kind, from its column, as (kind, a, z)."""
    number = F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(f"base_{kind}", lambda s: F.struct(number, s["a"].alias("a"), s["z"].alias("z")))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Trees | None = None, **how) -> DataFrame:
    """``docs`` with base_<kind> (a, z, m) and pii_spans (kind, a, z), sorted by kind as listed, then start.

    Null and empty texts have no spans; rows stand for themselves, so repeats,
    ties and null keys don't matter; a column of ``docs`` of an added name is
    replaced.  Each text is read whole, in time n log n of its matches.  An added
    span meets no base span; added spans of two kinds may overlap.
    """
    model = model or fit(docs, key, text, **how)
    docs = cleared(docs, ["pii_text", "pii_candidates", "pii_spans", *[f"base_{k}" for k in KINDS]], text)
    rows = candidates(docs, text)
    limit = "CASE c.kind " + " ".join(f"WHEN {i} THEN {model.thresholds[k]!r}D" for i, k in enumerate(KINDS)) + " END"
    more = F.expr(f"transform(filter(pii_candidates, c -> NOT c.own AND NOT c.other AND {model.score('c')} >= {limit}), c -> struct(c.kind AS kind, c.a AS a, c.z AS z))")
    rows = rows.withColumn("pii_spans", F.sort_array(F.concat(*[base_of(k) for k in KINDS], more)))
    return rows.drop("pii_candidates", "pii_text")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["a"].cast("string"), s["z"].cast("string"))), ",")


#: Characters of a piece that a text is cut into, so that a place in it is found without reading it from the start.
PIECE = 1024


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by the kind of its first in square brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["a"].alias("a"), s["z"].alias("z"), s["kind"].alias("kind"))))

    def part(pieces: Column, a: Column, z: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        some = F.slice(pieces, first + 1, F.floor((z - 1) / PIECE).cast("int") - first + 1)
        return F.when(z > a, F.substring(F.array_join(some, ""), a - first * PIECE + 1, z - a)).otherwise("")

    def replaced(x: Column) -> Column:
        ends = let(x["spans"]["z"], lambda v: scanned(v, lambda y, before: F.greatest(y, before)))
        def woven(e: Column) -> Column:
            before = lambda i: F.coalesce(F.get(e, i - 1), F.lit(0))
            one = lambda s, i: F.when(s["a"] >= before(i), F.concat(part(x["pieces"], before(i), s["a"]), F.element_at(names, s["kind"] + 1))).otherwise("")
            return F.concat(F.array_join(F.transform(x["spans"], one), ""), part(x["pieces"], F.element_at(e, -1), x["length"]))

        return let(ends, woven)

    whole = F.struct(ordered.alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.length(text).alias("length"))
    return F.when(F.size(spans) > 0, let(whole, replaced)).otherwise(text)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", **how) -> DataFrame:
    """``docs`` with its personal data replaced; ``length``, if there, is the new text's."""
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    rows = find(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names[key], names[text], **how)
    rows = rows.withColumn("pii_new", redacted(F.col(names[text]), F.col("pii_spans")))
    new = {text: F.col("pii_new"), length: F.when(F.size("pii_spans") > 0, F.length("pii_new").cast("long")).otherwise(F.col(names[length])) if length in names else None}
    return rows.select(*[(new[c] if c in new else F.col(n)).alias(c) for c, n in names.items()])
