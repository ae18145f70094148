"""Personal data: wide generators, boosted trees, calibrated thresholds. DataFrame functions only.

Base patterns give the spans that always count. Further generators propose spans of
looser formats, overlapping as they like. Every proposal becomes a row with a few
binned features of its format and context; a small boosted-tree model gives a score,
and a proposal clear of all base spans is added if it reaches its kind's threshold.

The trees learn from the corpus itself: base matches that pass or fail their check,
base spans rewritten into the looser formats (positive), and what the generators
propose elsewhere in a format that positives don't have (negative). Proposals in a
format of positives may be genuine, so nothing is learnt from them. Rows with equal
features are one weighted cell, and there are only so many cells, whatever the corpus;
boosting runs over that table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewmill.llm.common import table
from reviewmill.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Possessive repeats and look-behinds keep these linear in the text; they match what the plain forms match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20at\x20|\x20?[\[({<](?:at|AT)[\])}>]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20|\x20?[\[({<](?:dot|DOT)[\])}>]\x20?)[A-Za-z0-9-]{2,63}+){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+./-])\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])",
}
#: What a text must hold before a pattern is tried on it.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
CONTEXT = 24
KEYWORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|address|write|reach|send|message)\b",
    "ip": r"(?i)\b(?:ip|host|address)\b",
    "card": r"(?i)\b(?:card|visa|credit|account)\b",
    "phone": r"(?i)\b(?:phone|tel|call|contact|mobile|fax)\b",
}
#: Words before "at host.com" that aren't names.
ORDINARY = (
    "a all also am and are as available back be been best bought buy by check contact do down featured find first for found free from go going got have here him host hosted"
    " hour in info information is it just learn live local located look looked looking looks made me more new not now of off on one online only or order our out over"
    " page people post posted read register see seen sell shop shown sign site so sold staff start stay stop store team that the them there this to today up us visit was we website were what"
    " work working works write you"
).split()
#: Feature and its number of bins; a cell is one combination.
FEATURES = {"kind": 4, "wide": 2, "digits": 6, "luhn": 2, "octets": 2, "separators": 3, "before": 3, "after": 3, "keyword": 2, "ending": 2}
ROUNDS, RATE, PRECISION = 40, 0.3, 0.98




def find_all(text: Column, pattern: str) -> Column:
    """Per match in order: value, characters between the last match and this one, and the text to both sides."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))

    def rows(x: Column) -> Column:
        began = F.zip_with(x["values"], F.slice(x["gaps"], 1, F.size(x["values"])), lambda v, g: F.struct(v.alias("value"), F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("left")))
        after = F.slice(x["gaps"], 2, F.size(x["values"]))
        return F.zip_with(began, after, lambda b, g: F.struct(b["value"].alias("value"), b["gap"].alias("gap"), b["left"].alias("left"), F.left(g, F.lit(CONTEXT)).alias("right")))

    return F.transform(F.array(both), rows)[0]  # bound once, so each text is scanned once per use


def _tag(kind: int, wide: int):
    return lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), *[m[c].alias(c) for c in ("value", "gap", "left", "right")])


def candidates(text: Column) -> Column:
    """Array of (kind, wide, value, gap, left, right) of every pattern."""
    parts = []
    for wide, patterns in enumerate((BASE, WIDE)):
        for k, kind in enumerate(KINDS):
            found = find_all(text, patterns[kind])
            if not wide and kind in NEEDS:
                found = F.when(F.contains(text, F.lit(NEEDS[kind])), found)
            tagged = F.transform(found, _tag(k, wide))
            parts.append(F.coalesce(tagged, F.array().cast("array<struct<kind:int,wide:int,value:string,gap:int,left:string,right:string>>")))
    return F.concat(*parts)


def _digit_sum(digits: Column) -> Column:
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda total, d: total + F.when(d == "", 0).otherwise(d.cast("int")))


def luhn_valid(digits: Column) -> Column:
    """Every second digit from the right is doubled, its digits added; the sum ends in 0."""
    turned = F.reverse(digits)
    plain, doubled = F.regexp_replace(turned, "(.).?", "$1"), F.regexp_replace(turned, ".(.?)", "$1")
    return (_digit_sum(plain) + _digit_sum(F.translate(doubled, "0123456789", "0246813579"))) % 10 == 0


def _octets_valid(value: Column) -> Column:
    def fits(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.length(number) <= 3, number.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(value, r"\."), fits)


def _side(char: Column) -> Column:
    return F.when((char == "") | char.rlike(r"\s"), 0).when(char.rlike(r"[\p{L}\p{N}]"), 2).otherwise(1)


def described(rows: DataFrame) -> DataFrame:
    """Adds the binned features and ``valid``, the base check of the row's kind."""
    rows = rows.withColumn("number", F.regexp_replace("value", "[^0-9]", "")).withColumn("n", F.length("number"))
    marks = F.regexp_replace("value", "[A-Za-z0-9]", "")
    marks = F.when(F.col("kind") == 0, F.lit("")).otherwise(marks)
    is_kind = lambda k: F.col("kind") == KINDS.index(k)
    # Of a loose email instead: what its name is like, an ordinary word, letters, or more than a word.
    local = F.regexp_extract("value", r"^[A-Za-z0-9._%+-]+", 0)
    more = F.col("value").rlike(r"[\[({<]|\x20dot\x20") | local.rlike(r"[A-Za-z0-9][._%+]+[A-Za-z0-9]|[A-Za-z][0-9]|[0-9][A-Za-z]")
    name = F.when(more, 2).when(F.lower(local).isin(*ORDINARY) | ~local.rlike("[A-Za-z]"), 0).otherwise(1)
    context = F.concat_ws(" ", "left", "right")
    keyword = F.when(is_kind(KINDS[0]), context.rlike(KEYWORDS[KINDS[0]]))
    for kind in KINDS[1:]:
        keyword = keyword.when(is_kind(kind), context.rlike(KEYWORDS[kind]))
    rows = rows.withColumns({
        "digits": F.when(F.col("n") == 0, 0).when(F.col("n") < 8, 1).when(F.col("n") < 13, 2).when(F.col("n") < 16, 3).when(F.col("n") < 20, 4).otherwise(5),
        "luhn": F.when(F.col("n").between(12, 19), luhn_valid(F.col("number"))).otherwise(False).cast("int"),
        "octets": F.when(is_kind("ip") & (F.col("wide") == 0), _octets_valid(F.col("value"))).otherwise(False).cast("int"),
        "separators": F.when(is_kind("email") & (F.col("wide") == 1), name).when(marks == "", 0).when(F.length(F.replace(marks, F.left(marks, F.lit(1)), F.lit(""))) == 0, 1).otherwise(2),
        "before": _side(F.right("left", F.lit(1))),
        "after": _side(F.left("right", F.lit(1))),
        "keyword": keyword.cast("int"),
        "ending": F.col("value").rlike(r"[A-Za-z]{2,6}$").cast("int"),
    })
    valid = F.when(is_kind("email"), True).when(is_kind("ip"), F.col("octets") == 1)
    valid = valid.when(is_kind("card"), F.col("n").between(16, 19) & (F.col("luhn") == 1)).otherwise(F.col("n").between(8, 15))
    return rows.withColumn("valid", valid & (F.col("wide") == 0))


def rewritten(valid: DataFrame) -> DataFrame:
    """Base spans in the loose formats: what the generators should find."""
    hashed = F.md5("value")
    full = F.concat_ws(":", *[F.substring(hashed, 4 * i + 1, 4) for i in range(8)])
    short = F.concat_ws(":", F.lit("2001:db8:0:0"), *[F.substring(hashed, 4 * i + 1, i + 1) for i in range(4)])
    values = (
        F.when(F.col("kind") == KINDS.index("email"), F.array(*[F.replace("value", F.lit("@"), F.lit(at)) for at in (" at ", " [at] ")]))
        .when(F.col("kind") == KINDS.index("ip"), F.array(full, short))
        .when(F.col("kind") == KINDS.index("card"), F.array(F.translate("value", " -", "..")))
        .when(F.col("kind") == KINDS.index("phone"), F.array(F.substring("value", 2, 1 << 20)))
    )
    return described(valid.select("kind", F.lit(1).alias("wide"), F.explode(values).alias("value"), "left", "right"))


def maybe_genuine() -> Column:
    """Loose proposals in a format of positives: they aren't known to be negative."""
    is_kind = lambda k: F.col("kind") == KINDS.index(k)
    said = F.col("keyword") == 1
    like = is_kind("ip") | (is_kind("email") & ((F.col("separators") == 2) | ((F.col("separators") == 1) & said)))
    like |= is_kind("card") & (F.col("digits") == 4) & (F.col("luhn") == 1)
    like |= is_kind("phone") & F.col("digits").isin(2, 3) & said
    return (F.col("wide") == 1) & like


Tree = tuple | float


def _leaf(cells: list[tuple[tuple[int, ...], float, float]]) -> float:
    return RATE * sum(g for _, g, _ in cells) / (sum(h for *_, h in cells) + 1.0)


def _tree(cells: list[tuple[tuple[int, ...], float, float]], depth: int) -> Tree:
    """The regression tree of (features, gradient, curvature) cells with the most gain: (feature, below, left, right)."""
    gain_of = lambda part: sum(g for _, g, _ in part) ** 2 / (sum(h for *_, h in part) + 1.0)
    best, most = None, gain_of(cells) + 1e-9
    if depth:
        for f, bins in enumerate(FEATURES.values()):
            for below in range(1, bins):
                low, high = [c for c in cells if c[0][f] < below], [c for c in cells if c[0][f] >= below]
                if low and high and (gain := gain_of(low) + gain_of(high)) > most:
                    best, most = (f, below, low, high), gain
    if best is None:
        return _leaf(cells)
    f, below, low, high = best
    return (f, below, _tree(low, depth - 1), _tree(high, depth - 1))


def tree_value(tree: Tree, features: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        f, below, low, high = tree
        tree = low if features[f] < below else high
    return tree


def boost(cells: dict[tuple[int, ...], tuple[float, float]], rounds: int = ROUNDS, depth: int = 3) -> tuple[float, list[Tree]]:
    """Gradient boosting on the log-loss of (rows, positive rows) per cell."""
    n, good = (sum(c[i] for c in cells.values()) for i in (0, 1))
    first = math.log((good + 1) / (n - good + 1))
    margin, trees = dict.fromkeys(cells, first), []
    for _ in range(rounds):
        slopes = []
        for key, (rows, positive) in cells.items():
            p = 1 / (1 + math.exp(-margin[key]))
            slopes.append((key, positive - rows * p, rows * p * (1 - p)))
        trees.append(_tree(slopes, depth))
        for key in cells:
            margin[key] = max(-30.0, min(30.0, margin[key] + tree_value(trees[-1], key)))
    return first, trees


def score_column(first: float, trees: list[Tree]) -> Column:
    names = list(FEATURES)

    def value(tree: Tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, below, low, high = tree
        return F.when(F.col(names[f]) < below, value(low)).otherwise(value(high))

    total = F.lit(float(first))
    for tree in trees:
        total = total + value(tree)
    return 1 / (1 + F.exp(-total))


def thresholds(cells: dict[tuple[int, ...], tuple[float, float]], first: float, trees: list[Tree], precision: float) -> list[float]:
    """Per kind the lowest score down to which the loose proposals keep the wanted precision; over 1 if there is none."""
    limits = []
    for k in range(len(KINDS)):
        scored = sorted(((first + sum(tree_value(t, key) for t in trees), n, good) for key, (n, good) in cells.items() if key[:2] == (k, 1)), reverse=True)
        limit, rows, hits = 2.0, 0.0, 0.0
        for margin, n, good in scored:
            rows, hits = rows + n, hits + good
            if hits >= precision * rows and margin > 0:
                limit = 1 / (1 + math.exp(-min(margin, 700.0))) - 1e-9
        limits.append(limit)
    return limits


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Base spans per kind are leftmost, non-overlapping matches that pass their check.
    ``spans`` lists them and the added ones as kind:start:end (code points, end
    exclusive) by kind, then start. An added span overlaps no base span; added spans
    of different kinds may overlap.

    A null text is an empty one and has no span. Null ids and repeated rows are rows
    of their own. An empty table gives an empty table, and without base spans nothing
    is learnt and nothing added.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    stored = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(f"`{id_col}`").alias("doc_id"), candidates(text).alias("found"))
    stored = materialize(stored, "candidates")

    rows = stored.select("row_id", F.posexplode("found").alias("at", "m")).select("row_id", "at", "m.*").repartition("row_id")
    upto = Window.partitionBy("row_id", "kind", "wide").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(upto)).withColumn("start", F.col("end") - F.length("value"))
    rows = described(rows)
    before = Window.partitionBy("row_id").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row_id").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    covered = F.coalesce(F.max(F.when(F.col("valid"), F.col("end"))).over(before) > F.col("start"), F.lit(False))
    covered |= F.coalesce(F.min(F.when(F.col("valid"), F.col("start"))).over(after) < F.col("end"), F.lit(False))
    rows = rows.withColumn("covered", covered).filter("valid OR wide = 0 OR NOT covered")
    rows = materialize(rows.select("row_id", "start", "end", "value", F.right("left", F.lit(CONTEXT)).alias("left"), "right", "valid", *FEATURES), "spans")

    counted = rows.filter(~maybe_genuine()).select(*FEATURES, F.col("valid").cast("int").alias("good")).unionByName(rewritten(rows.filter("valid")).select(*FEATURES, F.lit(1).alias("good")))
    counted = counted.groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("good").alias("good")).collect()  # one row per cell
    cells = {tuple(r[f] for f in FEATURES): (float(r.n), float(r.good)) for r in sorted(counted, key=lambda r: tuple(r[f] for f in FEATURES))}
    first, trees = boost(cells) if cells else (0.0, [])
    limit = F.element_at(F.array(*[F.lit(x) for x in thresholds(cells, first, trees, precision)]), F.col("kind") + 1)
    kept = rows.filter(F.col("valid") | ((F.col("wide") == 1) & (score_column(first, trees) >= limit)))

    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("kind", "start", "end", F.concat_ws(":", name, "start", "end").alias("said"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["said"]), ",")
    counts = [F.count_if(F.col("valid") & (F.col("kind") == k)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    of = kept.groupBy(F.col("row_id").alias("of")).agg(*counts, listed(F.when(F.col("valid"), span)).alias("base"), listed(span).alias("spans"))
    numbers = [F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return stored.select("row_id", "doc_id").join(of, F.col("row_id") == F.col("of"), "left").select(
        "doc_id", *numbers, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")
    )


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
