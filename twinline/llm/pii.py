"""Personal data: wide candidate generators, boosted trees over format and context, calibrated thresholds.

Everything that touches a row is a column expression. What the trees are learnt from is the table of counts by
feature values, which the bins bound whatever the corpus holds; so they see every row.

Patterns are possessive and begin at the start of a run, so no text, however long, makes them try a run again from
each of its characters, and none of their loops nests calls.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinline.session import materialize

KINDS = ("email", "ip", "card", "phone")

_AT = r"(?:@| ?+[\[(]at[\])] ?+)"
_DOT = r"(?:\.| ?+[\[(](?:dot|\.)[\])] ?+)"
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
_NUMBER = r"(?:\G|(?<![0-9]))[0-9]++"
#: What is always found, once :func:`_valid` agrees.
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _NUMBER + r"(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates: also spelt-out marks, other separators, other lengths, numbers without a leading plus.
WIDE = {
    "email": _LOCAL + rf"(?:{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "ip": _NUMBER + rf"(?:{_DOT}[0-9]++){{3}}+",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]?+[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+|00)?+\(?+[0-9](?:[\x20().-]{0,2}+[0-9]){6,14}(?![0-9])",
}
#: Words before a finding that speak of it; fixed values.
CUES = {
    "email": r"(?i)mail|contact|write|reach",
    "ip": r"(?i)\bip\b|host|server|address|addr",
    "card": r"(?i)card|visa|master|amex|credit|payment|karte|tarjeta|carte",
    "phone": r"(?i)phone|tel|call|mobile|fax|ring|anruf",
}
FEATURES = ("before", "after", "cue", "f1", "f2", "f3", "f4")
BINS = (4, 4, 2, 4, 5, 5, 2)  # values of each, which bound the table of counts
CONTEXT = 32
PRECISION = 0.9  # of a held-out fold, which a threshold must reach with one more miss
ROUNDS = 24
_MARK = "\x01"

CANDIDATE = (
    "struct<kind:int,base:boolean,overlaps:boolean,label:boolean,start:long,end:long,"
    + ",".join(f"{f}:int" for f in FEATURES) + ">"
)


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut around every match: texts between at even places, matches at odd ones."""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _any(text: Column, *parts: str) -> Column:
    hit = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        hit = hit | F.contains(text, F.lit(p))
    return hit


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_row, doc_id, kind, wide, place, gap, found, lead, trail``: every match, and a row without a match for each document.

    ``gap`` is the length of the text since the match before. Texts are read once and not moved.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(doc_id).cast("long").alias("doc_id"),
        # The mark is in no pattern and in no finding; another such character takes its place.
        F.translate(F.col(text), _MARK, "\x02").alias("_t"),
    )
    t = F.col("_t")
    worth = {
        ("email", False): _any(t, "@"), ("email", True): _any(t, "@", "(at", "[at", " at "), ("phone", False): _any(t, "+"),
    }
    cuts = [F.struct(F.lit(-1).alias("kind"), F.lit(False).alias("wide"), F.array(F.lit("")).alias("pieces"))]
    for wide, patterns in ((False, BASE), (True, WIDE)):
        for k, kind in enumerate(KINDS):
            made = _pieces(t, patterns[kind])
            if (kind, wide) in worth:
                made = F.when(worth[kind, wide], made)
            cuts.append(F.struct(F.lit(k).alias("kind"), F.lit(wide).alias("wide"), made.alias("pieces")))
    cut = rows.select("_row", "doc_id", F.inline(F.array(*cuts))).filter((F.col("kind") < 0) | (F.size("pieces") > 1))
    pieces = F.col("pieces")
    matches = F.when(
        F.size(pieces) > 1,
        F.transform(
            F.sequence(F.lit(0), F.floor(F.size(pieces) / 2).cast("int") - 1),
            lambda i: F.struct(
                i.alias("place"), F.length(F.get(pieces, 2 * i)).cast("long").alias("gap"),
                F.get(pieces, 2 * i + 1).alias("found"), F.right(F.get(pieces, 2 * i), F.lit(CONTEXT)).alias("lead"),
                F.left(F.get(pieces, 2 * i + 2), F.lit(1)).alias("trail"),
            ),
        ),
    )
    return cut.select("_row", "doc_id", "kind", "wide", F.inline_outer(matches))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _small_parts(found: Column) -> Column:
    """All four numbers are at most 255."""
    parts = F.split(F.regexp_replace(found, "[^0-9]+", "."), r"\.")
    return F.forall(parts, lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _valid(kind: Column, found: Column) -> Column:
    n = F.length(_digits(found))
    return (
        F.when(kind == 0, True)
        .when(kind == 1, _small_parts(found))
        .when(kind == 2, F.when(n.between(16, 19), F.call_function("luhn_check", _digits(found))).otherwise(False))
        .when(kind == 3, n.between(8, 15))
        .otherwise(False)
    )


def _bin(value: Column, *edges: int) -> Column:
    """How many of ``edges`` the value reaches."""
    return sum(((value >= e).cast("int") for e in edges), F.lit(0))


def _formats(kind: Column, found: Column) -> list[Column]:
    """Four features of the form. None tells what alone makes a base finding: the plain at and dots, the plus, the check digit."""
    n = F.length(_digits(found))
    groups = F.size(F.regexp_extract_all(found, F.lit("[0-9]+"), F.lit(0)))
    local = F.regexp_extract(found, r"^[A-Za-z0-9._%+-]+", 0)
    host = F.regexp_replace(F.substring(found, F.length(local) + 1, F.length(found)), r"(?i)[^A-Za-z0-9-]+(?:at|dot|\.)?[^A-Za-z0-9-]*", ".")
    top = F.substring_index(host, ".", -1)
    first = F.regexp_extract(found, "[0-9]+", 0)
    separators = F.length(found) - n
    distinct = F.size(F.array_distinct(F.split(_digits(found), "")))
    last = F.length(F.regexp_extract(found, "[0-9]+$", 0))
    email = (
        _bin(F.length(local), 2, 4, 9), _bin(F.length(host) - F.length(F.replace(host, F.lit("."))), 2, 3, 4),
        F.when(top.rlike("[0-9]"), 4).otherwise(_bin(F.length(top), 2, 3, 4)), local.rlike("[0-9]").cast("int"),
    )
    ip = (_bin(F.length(first), 2, 3, 4), F.lit(0), _bin(F.length(found), 10, 13, 16), _small_parts(found).cast("int"))
    card = (
        _bin(n, 15, 16, 17), F.when(first.rlike("^[3-6]"), F.substring(first, 1, 1).cast("int") - 2).otherwise(0),
        F.when(separators == 0, 0).when(separators == 3, 1).otherwise(2), (distinct <= 3).cast("int"),
    )
    phone = (_bin(n, 8, 10, 12), _bin(groups, 2, 3, 4, 5), _bin(last, 2, 3, 4, 5), F.contains(found, F.lit("(")).cast("int"))
    return [
        F.when(kind == 0, a).when(kind == 1, b).when(kind == 2, c).otherwise(d).cast("int")
        for a, b, c, d in zip(email, ip, card, phone)
    ]


def _context(kind: Column, lead: Column, trail: Column) -> list[Column]:
    last = F.right(lead, F.lit(1))
    before = F.when(last == "", 0).when(last.rlike(r"\s"), 1).when(last.rlike("[\"'=:<(]"), 2).otherwise(3)
    after = F.when(trail == "", 0).when(trail.rlike(r"\s"), 1).when(trail.rlike("[.,;:!?]"), 2).otherwise(3)
    cue = F.lit(False)
    for k, pattern in enumerate(CUES.values()):
        cue = F.when(kind == k, lead.rlike(pattern)).otherwise(cue)
    return [before, after, cue.cast("int")]


def located(found: DataFrame) -> DataFrame:
    """One row a document: ``_row, doc_id, candidates`` with code-point places, features, and what base findings they touch.

    The rows of a document meet by one shuffle of the matches; its text stays where it is.
    """
    rows = found.repartition("_row")
    text_order = Window.partitionBy("_row", "kind", "wide").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("found")
    end = F.sum(F.col("gap") + size).over(text_order)
    kind, span = F.col("kind"), F.col("found")
    names = dict(zip(FEATURES, [*_context(kind, F.col("lead"), F.col("trail")), *_formats(kind, span)]))
    placed = rows.select(
        "_row", "doc_id", "kind", "wide", (end - size).alias("start"), end.alias("end"),
        (~F.col("wide") & _valid(kind, span)).alias("base"), *[c.alias(n) for n, c in names.items()],
    ).filter("kind < 0 or wide or base")
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))

    def touches(*keys: str) -> Column:
        """Whether a base finding of the same ``keys`` overlaps, from those that begin before and those that begin after."""
        spec = Window.partitionBy(*keys)
        so_far = (Window.unboundedPreceding, -1)
        ahead = F.max(base_end).over(spec.orderBy("start", "end", "wide").rowsBetween(*so_far)) > F.col("start")
        behind = F.min(base_start).over(
            spec.orderBy(F.desc("start"), F.desc("end"), F.desc("wide")).rowsBetween(*so_far)
        ) < F.col("end")
        return F.coalesce(ahead, F.lit(False)) | F.coalesce(behind, F.lit(False))

    marked = placed.withColumn("overlaps", touches("_row")).withColumn("label", touches("_row", "kind"))
    fields = [F.col(f.split(":")[0]) for f in CANDIDATE[7:-1].split(",")]
    return marked.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.collect_list(F.when(kind >= 0, F.struct(*fields))).cast(f"array<{CANDIDATE}>").alias("candidates"),
    )


# Boosting over the table of counts


@dataclass
class Tree:
    """A leaf's value, or a question ``feature <= at`` with two branches."""

    value: float = 0.0
    feature: str = ""
    at: int = 0
    low: "Tree | None" = None
    high: "Tree | None" = None

    def of(self, cell: dict[str, int]) -> float:
        if self.low is None:
            return self.value
        return (self.low if cell[self.feature] <= self.at else self.high).of(cell)

    def column(self, get: Callable[[str], Column]) -> Column:
        if self.low is None:
            return F.lit(self.value)
        return F.when(get(self.feature) <= self.at, self.low.column(get)).otherwise(self.high.column(get))


@dataclass
class Model:
    """Log-odds of one kind: a start and trees; and the least log-odds that is redacted, infinite for none."""

    start: float
    trees: list[Tree]
    threshold: float = math.inf

    def of(self, cell: dict[str, int]) -> float:
        return self.start + sum(t.of(cell) for t in self.trees)

    def column(self, get: Callable[[str], Column]) -> Column:
        return sum((t.column(get) for t in self.trees), F.lit(self.start))


def _grow(cells: list[dict], depth: int, rate: float) -> Tree:
    """The split with the largest gain of the logistic loss, to second order; ties go to the first feature and value."""
    g, h = sum(c["g"] for c in cells), sum(c["h"] for c in cells)
    leaf = Tree(rate * g / (h + 1.0))
    if depth == 0:
        return leaf
    best_gain, best = 1e-6, None
    for f, bins in zip(FEATURES, BINS):
        gs, hs = [0.0] * bins, [0.0] * bins
        for c in cells:
            gs[c[f]] += c["g"]
            hs[c[f]] += c["h"]
        gl = hl = 0.0
        for v in range(bins - 1):
            gl, hl = gl + gs[v], hl + hs[v]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best_gain:
                best_gain, best = gain, (f, v)
    if best is None:
        return leaf
    f, v = best
    low, high = [c for c in cells if c[f] <= v], [c for c in cells if c[f] > v]
    if not low or not high:
        return leaf
    return Tree(0.0, f, v, _grow(low, depth - 1, rate), _grow(high, depth - 1, rate))


def boost(cells: list[dict], rounds: int = ROUNDS, depth: int = 2, rate: float = 0.4) -> Model:
    """Gradient boosting of the logistic loss on cells with ``n`` rows, ``pos`` of them positive."""
    n, pos = sum(c["n"] for c in cells), sum(c["pos"] for c in cells)
    model = Model(math.log((pos + 0.5) / (n - pos + 0.5)), [])
    scores = [model.start] * len(cells)
    for _ in range(rounds if 0 < pos < n else 0):
        for c, s in zip(cells, scores):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
            c["g"], c["h"] = c["pos"] - c["n"] * p, c["n"] * p * (1 - p)
        tree = _grow(cells, depth, rate)
        model.trees.append(tree)
        scores = [s + tree.of(c) for s, c in zip(scores, cells)]
    return model


def calibrate(model: Model, cells: list[dict], precision: float) -> float:
    """The lowest log-odds whose calibrated share of hits reaches ``precision``, one more miss counted; infinite if none does.

    The share falls with the log-odds: neighbours that break this are pooled, so a few poor cells do not hide behind
    many good ones.
    """
    pooled: list[list[float]] = []  # lowest log-odds, rows, hits
    for s, n, pos in sorted(((model.of(c), c["n"], c["pos"]) for c in cells), key=lambda x: -x[0]):
        pooled.append([s, n, pos])
        while len(pooled) > 1 and pooled[-1][2] * pooled[-2][1] >= pooled[-2][2] * pooled[-1][1]:
            s, n, pos = pooled.pop()
            pooled[-1] = [s, pooled[-1][1] + n, pooled[-1][2] + pos]
    return min((s - 1e-9 for s, n, pos in pooled if pos >= precision * (n + 1)), default=math.inf)


def learn(found: DataFrame, precision: float = PRECISION) -> list[Model]:
    """A model a kind. A wide candidate that touches a base finding of its kind counts as personal data.

    Rows whose id has a checksum divisible by five are held out for the threshold. The counts that come to the driver are at most
    the product of ``BINS`` for each kind and fold, whatever the number of rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = found.select(held.alias("held"), F.inline("candidates")).filter(~F.col("base"))
    counted = rows.groupBy("held", "kind", *FEATURES).agg(F.count("*").alias("n"), F.count_if("label").alias("pos"))
    cells = [r.asDict() for r in counted.collect()]
    cells.sort(key=lambda c: [c[f] for f in ("kind", *FEATURES)])
    models = []
    for k in range(len(KINDS)):
        model = boost([c for c in cells if c["kind"] == k and not c["held"]])
        model.threshold = calibrate(model, [c for c in cells if c["kind"] == k and c["held"]], precision)
        models.append(model)
    return models


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", precision: float = PRECISION) -> DataFrame:
    """``doc_id, base, spans`` of every row: arrays of ``(kind, start, end)`` in code points, the end exclusive.

    ``base`` holds the patterns' valid findings. ``spans`` has them too, and each wide candidate that touches none of
    them and whose log-odds reach its kind's threshold. Null and empty texts have none; rows with equal or missing ids
    each have their own; an empty table gives none; other columns are not read. Findings of a kind never overlap.
    """
    found = materialize(located(candidates(docs, doc_id, text)), "pii-candidates")
    models = learn(found, precision)

    def selected(c: Column) -> Column:
        passes = F.lit(False)
        for k, m in enumerate(models):
            if m.threshold < math.inf:
                passes = F.when(c["kind"] == k, m.column(lambda f: c[f]) >= m.threshold).otherwise(passes)
        return c["base"] | (~c["overlaps"] & passes)

    span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("candidates", lambda c: c["base"]), span))
    spans = F.array_sort(F.transform(F.filter("candidates", selected), span))
    return found.select("doc_id", base.alias("base"), spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, line), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", precision: float = PRECISION) -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_row"))
    stored = materialize(rows, "pii-rows")
    found = detect(stored, "_row", "text", precision).withColumnRenamed("doc_id", "_at")
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    begin = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    body = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        after = F.struct(F.concat(acc["done"], kept, F.get(names, s["kind"])).alias("done"), s["end"].alias("at"))
        return F.when(s["start"] < acc["at"], acc).otherwise(after)

    done = F.aggregate(order, begin, step, lambda acc: F.concat(acc["done"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))))
    return stored.join(found, F.col("_row") == F.col("_at")).select("doc_id", done.alias("text"))
