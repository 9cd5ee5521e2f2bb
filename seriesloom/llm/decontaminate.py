"""Benchmark passages in documents, also with other numbers, names and units: DataFrame functions only.

Texts become templates: names inside a sentence, numbers and units after numbers turn into typed placeholders, everything
else is a lower-cased word. In a second template capitalised words that open a sentence, line or quotation are names too.
White space of any kind and length is one blank. Windows of ``WINDOW`` tokens are hashed and joined with those of the benchmark. Windows of one
document and item that lie on one diagonal (document position minus item position) are judged together: the values that
fill the item's placeholders should map to one value each in the document. Windows with a value that maps to two count
only where they equal the item's word for word. A document is contaminated by an item if windows of diagonals without
such a conflict cover ``COVERAGE`` of the item's tokens, or all windows that count cover ``RUN`` tokens.

Null ids are kept as a null id; null and empty texts match nothing. Rows with one id are judged apart if their texts
differ and once if they are equal. Items of fewer than ``WINDOW`` tokens are matched as a whole, those of fewer than
``SHORTEST`` never. Typed windows with fewer than half of their tokens as words are left out, unless an item has no others. Every
window with a placeholder is matched as it stands beside (lower-cased, values included), so that copies of items rich in
numbers are covered as far as they are copied; with other values, such windows match nothing.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import stored

WINDOW = 8
SHORTEST = 3
COVERAGE = 0.5
RUN = 25
#: Rows of benchmark windows up to which they are broadcast (16 bytes a row and its hash table: under 100 MB).
BROADCAST_ROWS = 1_000_000

#: Marks before tokens, in this order, and the first character after them.
NAME, NUMBER, UNIT, OPENING, AFTER = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
MARKS = NAME + NUMBER + UNIT + OPENING
#: Kinds of windows: of the words and numbers as they stand, with placeholders, and with all capitalised words as names.
PLAIN, TYPED, OPENED = 0, 1, 2
TYPED_KINDS = (TYPED, OPENED)
KINDS = (*TYPED_KINDS, PLAIN)
UNITS = (
    "km|cm|mm|nm|m|kg|mg|g|lb|lbs|oz|l|ml|s|ms|h|min|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|v|mv|j|kj|pa|kpa|k|c|f|usd|eur|gbp|"
    "kilometers?|kilometres?|meters?|metres?|centimeters?|centimetres?|miles?|feet|foot|inch|inches|yards?|kilograms?|grams?|pounds?|ounces?|tons?|"
    "liters?|litres?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|percent|degrees?|dollars?|euros?|cents?"
)


def marked_tokens(text: Column) -> Column:
    """Lower-cased words and numbers; names, numbers, units and capitalised words that open something follow a mark of their kind."""
    plain = F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\s\p{{Z}}{MARKS}]+", " "), F.lit("\u0130"), F.lit("I"))
    opened = F.regexp_replace(plain, r"\p{Lu}(?<!\p{L}.)\p{Ll}+(?!\p{L})", OPENING + "$0")
    named = F.regexp_replace(opened, rf"{OPENING}(?<=[\p{{Ll}}\p{{N}},;:] .)", NAME)
    measured = F.regexp_replace(named, rf"(\p{{N}}+(?:[.,]\p{{N}}+)*)(?: ?((?i:{UNITS}))(?!\p{{L}}))?", f" {NUMBER}$1 {UNIT}$2 ")
    return F.regexp_extract_all(F.lower(measured), F.lit(rf"[{MARKS}]?(?:\p{{N}}+(?:[.,]\p{{N}}+)*|\p{{L}}+)"), F.lit(0))


def _without_mark(token: Column) -> Column:
    return F.ltrim(token, F.lit(MARKS))


def _placeholder(token: Column, kind: int) -> Column:
    """Whether a marked token is a placeholder in windows of a kind."""
    return F.lit(False) if kind == PLAIN else (token >= NAME) & (token < (AFTER if kind == OPENED else OPENING))


def _token_hashes(tokens: Column) -> dict[int, Column]:
    """Hashes of the marked tokens, for each kind of window."""
    plain = F.transform(tokens, lambda t: F.xxhash64(_without_mark(t)))
    name, number, unit = (F.xxhash64(F.lit(m)) for m in (NAME, NUMBER, UNIT))
    typed = F.zip_with(tokens, plain, lambda t, h: F.when((t < NAME) | (t >= OPENING), h).when(t < NUMBER, name).when(t < UNIT, number).otherwise(unit))
    opened = F.zip_with(tokens, typed, lambda t, h: F.when((t >= OPENING) & (t < AFTER), name).otherwise(h))
    return {PLAIN: plain, TYPED: typed, OPENED: opened}


def _joined(a: str, b: str, offset: int) -> Column:
    """Hash of each entry of ``a`` with the entry of ``b`` that lies ``offset`` ahead."""
    n = F.greatest(F.size(b) - offset, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(offset + 1), n), lambda x, y: F.xxhash64(x, y))


def _with_hashes(df: DataFrame, tokens: str, width: int) -> DataFrame:
    """Adds the hashes of all windows of each kind as w0, w1 ...; null where a kind repeats the typed window, none if it always does."""
    # One projection for each level: an expression that is used twice is not computed twice.
    df = df.withColumns({f"h{k}": c for k, c in _token_hashes(F.col(tokens)).items()})
    typed, none = F.col(f"h{TYPED}"), F.array().cast("array<bigint>")
    df = df.withColumns({f"p{k}_1": typed if k == TYPED else F.when(F.col(f"h{k}") == typed, none).otherwise(F.col(f"h{k}")) for k in KINDS})
    made = 1
    while 2 * made <= width:
        df = df.withColumns({f"p{k}_{2 * made}": _joined(f"p{k}_{made}", f"p{k}_{made}", made) for k in KINDS})
        made *= 2
    df = df.withColumns({f"w{k}": F.col(f"p{k}_{made}") for k in KINDS})
    done, bit = made, made // 2
    while bit:
        if width & bit:
            df = df.withColumns({f"w{k}": _joined(f"w{k}", f"p{k}_{bit}", done) for k in KINDS})
            done += bit
        bit //= 2
    own = {f"w{k}": F.when(F.size(f"w{k}") > 0, F.zip_with(f"w{k}", f"w{TYPED}", lambda a, b: F.when(a != b, a))).otherwise(F.col(f"w{k}")) for k in KINDS if k != TYPED}
    return df.withColumns(own).select(*[c for c in df.columns if c[0] not in "hpw" or not c[1:2].isdigit()], *[f"w{k}" for k in KINDS])


def _literals(tokens: Column, n: Column, width: int, kind: int) -> Column:
    """Number of tokens that are words in every window."""
    return F.transform(F.sequence(F.lit(0), n - width), lambda i: F.size(F.filter(F.slice(tokens, i + 1, width), lambda t: ~_placeholder(t, kind))))


def _placed_windows(kind: int) -> Column:
    """The windows of a kind with their places, their words and the words that they need."""
    fields = lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("item_pos"), h.alias("hash"), F.get(f"l{kind}", i).alias("literals"), F.col(f"m{kind}").alias("least"))
    return F.transform(f"w{kind}", fields)


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item_id, item_key, width, kind, item_pos, hash) of all windows that count, and the items with their tokens."""
    items = (
        benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("item_text"))
        .distinct()
        .select("item_id", F.xxhash64("item_text").alias("item_key"), marked_tokens(F.col("item_text")).alias("item_tokens"))
        .withColumn("n_item", F.size("item_tokens"))
        .where(F.col("n_item") >= SHORTEST)
    )
    items = stored(items, "benchmark-items")
    parts = []
    # An empty benchmark has the columns of any width.
    for width in sorted(r[0] for r in items.select(F.least("n_item", F.lit(WINDOW))).distinct().collect()) or [WINDOW]:
        own = items.where(F.col("n_item") == width) if width < WINDOW else items.where(F.col("n_item") >= WINDOW)
        # All kinds in one pass: a plan for each of them would hash, and compile the hashing, three times.
        counted = _with_hashes(own, "item_tokens", width).withColumns({f"l{k}": _literals(F.col("item_tokens"), F.col("n_item"), width, k) for k in KINDS})
        half = F.lit((width + 1) // 2)
        counted = counted.withColumns({f"m{k}": F.least(half, F.array_max(f"l{k}")) if k == TYPED else half for k in KINDS})
        of_kinds = F.concat(*[_placed_windows(k) for k in KINDS])
        parts.append(
            counted.select("item_id", "item_key", F.inline(of_kinds))
            .where(F.col("hash").isNotNull() & (F.col("literals") >= F.col("least")))
            .select("item_id", "item_key", F.lit(width).alias("width"), "kind", "item_pos", "hash")
        )
    windows = parts[0]
    for p in parts[1:]:
        windows = windows.unionByName(p)
    return windows, items


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per contaminated document (by id and text) and item.

    Columns: doc_id, doc_key (hash of the text), item_id, kind (``exact``, ``reparameterised``), n_item, n_covered,
    coverage, n_slots (values that fill placeholders), n_changed (of them, other than in the item).
    """
    windows, items = benchmark_windows(benchmark, item_col, item_text_col)
    windows = stored(windows, "benchmark-windows")
    size = {r["width"]: r["n"] for r in windows.groupBy("width").agg(F.count("*").alias("n")).collect()}
    few = sum(size.values()) <= BROADCAST_ROWS
    place = ["item_id", "item_key", "item_pos", "kind"]
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    coded = texts.select("doc_id", F.xxhash64("text").alias("doc_key"), marked_tokens(F.col("text")).alias("tokens"))
    found = None
    for width in sorted(size):
        own = windows.where(F.col("width") == width).drop("width")
        hashed = _with_hashes(coded, "tokens", width)
        # The kinds follow each other, with as many windows each or none.
        placed = hashed.select("doc_id", "doc_key", F.size(f"w{TYPED}").alias("n"), F.posexplode(F.concat(*[f"w{k}" for k in KINDS])).alias("at", "hash")).where("hash is not null").select("doc_id", "doc_key", (F.col("at") % F.col("n")).alias("doc_pos"), "hash")
        if few:
            slim = own.groupBy("hash").agg(F.collect_list(F.struct(*place)).alias("places"))
            hits = placed.join(F.broadcast(slim), "hash").select("doc_id", "doc_key", "doc_pos", F.explode("places").alias("p")).select("doc_id", "doc_key", "doc_pos", *[f"p.{c}" for c in place])
        else:
            hits = placed.join(own, "hash").select("doc_id", "doc_key", "doc_pos", *place)
        hits = hits.withColumn("width", F.lit(width))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = coded.select("doc_id", "doc_key", F.lit(0).alias("doc_pos"), F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("item_key"), F.lit(0).alias("item_pos"), F.lit(0).alias("kind"), F.lit(0).alias("width")).where(F.lit(False))
    lines = stored(
        found.groupBy("doc_id", "doc_key", "item_id", "item_key", (F.col("doc_pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set(F.struct("item_pos", "width", "kind")).alias("at")),
        "benchmark-hits",
    )
    # Raw texts of hit documents only: their number follows the hits, and the join is left to the planner.
    hit = lines.select("doc_key").distinct()
    shown = texts.withColumn("doc_key", F.xxhash64("text")).join(hit, "doc_key", "left_semi").groupBy("doc_key").agg(F.min("text").alias("text"))
    shown = shown.select("doc_key", F.transform(marked_tokens(F.col("text")), _without_mark).alias("doc_raw"))
    own = items.withColumn("item_raw", F.transform("item_tokens", _without_mark))
    judged = (
        _judged(lines.join(shown, "doc_key").join(own, (lines.item_id.eqNullSafe(own.item_id)) & (lines.item_key == own.item_key)).drop(own.item_id).drop(own.item_key))
        .groupBy("doc_id", "doc_key", "item_id", "item_key")
        .agg(
            F.first("n_item").alias("n_item"),
            F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_covered"),
            F.size(F.array_distinct(F.flatten(F.collect_list("firm")))).alias("n_firm"),
            F.sum(F.size("slots")).alias("n_slots"),
            F.sum(F.size(F.filter("slots", lambda s: ~s["was"].eqNullSafe(s["now"])))).alias("n_changed"),
        )
    )
    return judged.where((F.col("n_firm") >= COVERAGE * F.col("n_item")) | (F.col("n_covered") >= RUN)).select(
        "doc_id", "doc_key", "item_id",
        F.when(F.col("n_changed") > 0, "reparameterised").otherwise("exact").alias("kind"),
        F.col("n_item").cast("long").alias("n_item"), F.col("n_covered").cast("long").alias("n_covered"),
        (F.col("n_covered") / F.col("n_item")).alias("coverage"), F.col("n_slots").cast("long").alias("n_slots"), F.col("n_changed").cast("long").alias("n_changed"),
    )


def _positions(windows: Column) -> Column:
    """The item positions that windows cover."""
    return F.array_distinct(F.flatten(F.transform(windows, lambda a: F.sequence(a["item_pos"], a["item_pos"] + a["width"] - 1))))


def _slots(positions: Column, kind: int) -> Column:
    """Position and both values of the placeholders among positions."""
    return F.transform(
        F.filter(positions, lambda p: _placeholder(F.get("item_tokens", p), kind)),
        lambda p: F.struct(p.alias("at"), F.get("item_raw", p).alias("was"), F.get("doc_raw", p + F.col("shift")).alias("now")),
    )


def _of_kind(kind: int) -> Column:
    return F.filter("at", lambda a: a["kind"] == kind)


def _conflicting(pairs: str) -> Column:
    """Values that map to two."""
    twice = F.filter(pairs, lambda x: F.exists(pairs, lambda y: (x["was"] == y["was"]) & ~x["now"].eqNullSafe(y["now"])))
    return F.array_distinct(F.transform(twice, lambda x: x["was"]))


def _kept(kind: int) -> Column:
    """The windows without a conflicting value, and those that equal the item's."""

    def stays(a):
        equal = F.slice("item_raw", a["item_pos"] + 1, a["width"]) == F.slice("doc_raw", a["item_pos"] + F.col("shift") + 1, a["width"])
        values = F.transform(_slots(F.sequence(a["item_pos"], a["item_pos"] + a["width"] - 1), kind), lambda s: s["was"])
        return equal | ~F.arrays_overlap(values, F.col(f"clash{kind}"))

    return F.when(F.size(f"clash{kind}") == 0, F.col(f"own{kind}")).otherwise(F.filter(f"own{kind}", stays))


def _judged(lines: DataFrame) -> DataFrame:
    """Adds the item positions that count on each diagonal (covered), those of windows without a conflict (firm), and the slots.

    A value conflicts if it maps to two. Windows that hold a conflicting value count only where they equal the item's.
    """
    df = lines
    for k in TYPED_KINDS:
        pairs = F.transform(_slots(_positions(F.col(f"own{k}")), k), lambda s: F.struct(s["was"], s["now"]))
        df = df.withColumn(f"own{k}", _of_kind(k)).withColumn(f"pairs{k}", F.array_distinct(pairs)).withColumn(f"clash{k}", _conflicting(f"pairs{k}")).withColumn(f"kept{k}", _kept(k))
    none, plain = F.slice("at", 1, 0), _of_kind(PLAIN)
    firm = F.concat(F.when(F.size(f"clash{TYPED}") == 0, plain).otherwise(none), *[F.when(F.size(f"clash{k}") == 0, F.col(f"own{k}")).otherwise(none) for k in TYPED_KINDS])
    slots = F.array_distinct(F.concat(*[_slots(_positions(F.col(f"kept{k}")), k) for k in TYPED_KINDS]))
    return df.withColumn("covered", _positions(F.concat(plain, *[F.col(f"kept{k}") for k in TYPED_KINDS]))).withColumn("firm", _positions(firm)).withColumn("slots", slots)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, that no benchmark item contaminates."""
    bad = stored(contaminations(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("doc_key").alias("bad_key")).distinct(), "contaminated")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.join(bad, (F.col("bad_key") == F.xxhash64("text")) & F.col("doc_id").cast("long").eqNullSafe(F.col("bad_id")), "left_anti")
