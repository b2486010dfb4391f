"""Personal data by fixed forms and by bootstrapped contexts.

Fixed forms give the base spans. They are also the seeds of a bootstrap: the words around a seed make
patterns; a pattern whose slot is mostly filled by trusted values vouches for the other
identifier-like values in its slot; values vouched for well enough become trusted in turn.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import settled_columns
from feedloom.llm.common import cut_pieces, gathered, seeded, text_pieces, unwrapped, whole_text, wrapped
from feedloom.session import settle

KINDS = ("email", "ip", "card", "phone")

# The forms as given, written without backtracking: a run is entered at its start only (or where the
# last match ended) and never given back, so long runs stay linear.
_LOCAL = r"[A-Za-z0-9._%+-]"
FORMS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINTS = {"email": "@", "phone": "+"}
#: Up to 255, with any zeros before it.
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|(?<=0))"

#: A token that may be an identifier: six or more signs, a digit or an @ among them.
_SIGN = r"[A-Za-z0-9._%+@-]"
IDENTIFIER = rf"(?<!{_SIGN})(?=[A-Za-z._%+-]*+[0-9@]){_SIGN}{{5,}}[A-Za-z0-9]"

#: Production parameters of the bootstrap.
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
MIN_BELIEF = 0.9
#: Code points before and after a value that are searched first for its context words. Where these do not
#: hold the words whole, wider ones are taken, and at last all of the text.
WINDOWS = ((48, 24), (1024, 1024))

MASKS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")
_SPAN = "start INT, kind INT, stop INT"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to twenty digits pass the Luhn check."""
    plain = F.lpad(digits, 20, "0")
    doubled = F.translate(plain, "0123456789", "0246813579")
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(20)),
        F.lit(0),
        lambda sum_, i: sum_ + F.when(i % 2 == 1, F.substr(doubled, i, F.lit(1))).otherwise(F.substr(plain, i, F.lit(1))).cast("int"),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    size = F.length(_digits(value))
    if kind == "card":
        return size.between(14, 19) & F.when(size <= 19, luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return size.between(10, 15)
    return F.lit(True)


_HIT = "struct<start:int,stop:int,value:string>"


def matches(text: Column, form: str) -> Column:
    """(start, stop, value) of the matches of a form, in code points, from its matches and what lies between."""
    # Both arrays are made once; the last gap has no match behind it.
    pairs = F.zip_with(
        F.split(text, form, -1),
        F.regexp_extract_all(text, F.lit(form), F.lit(0)),
        lambda gap, value: F.struct(
            F.char_length(gap).alias("gap"), F.char_length(value).alias("size"), value.alias("value")
        ),
    )

    def hit(at: Column, p: Column) -> Column:
        begin = at + p["gap"]
        return F.array(F.struct(begin.alias("start"), (begin + p["size"]).alias("stop"), p["value"].alias("value")))

    found = F.filter(pairs, lambda p: p["value"].isNotNull())
    return gathered(found, F.lit(0), lambda at, p: at + p["gap"] + p["size"], hit, _HIT)


def free_of(loose: Column, base: Column) -> Column:
    """The `loose` hits, of which none overlap, that overlap no `base` span either, in one walk over both by start."""
    sides = [
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("side"), b["stop"].alias("stop"), F.lit(None).cast("string").alias("value"))),
        F.transform(loose, lambda h: F.struct(h["start"].alias("start"), F.lit(1).alias("side"), h["stop"].alias("stop"), h["value"].alias("value"))),
        # What is held back at the end is passed on by one more loose hit, beyond all texts, which itself never is.
        F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(1).alias("side"), F.lit(2**31 - 1).alias("stop"), F.lit(None).cast("string").alias("value"))),
    ]
    nothing = F.lit(None).cast(_HIT)

    def carry(c: Column, x: Column) -> Column:
        # A loose hit waits until what comes next shows that no base span begins within it.
        mine = F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"))
        return F.struct(
            F.when(x["side"] == 0, F.greatest(c["reach"], x["stop"])).otherwise(c["reach"]).alias("reach"),
            F.when((x["side"] == 1) & (c["reach"] <= x["start"]), mine).otherwise(nothing).alias("waits"),
        )

    def emit(c: Column, x: Column) -> Column:
        stays = c["waits"].isNotNull() & ((x["side"] == 1) | (x["start"] >= c["waits"]["stop"]))
        return F.when(stays, F.array(c["waits"])).otherwise(F.array().cast(f"array<{_HIT}>"))

    start = F.struct(F.lit(0).alias("reach"), nothing.alias("waits"))
    return gathered(F.array_sort(F.concat(*sides)), start, carry, emit, _HIT)


def _hits(text: Column, kind: str) -> Column:
    """Valid matches of a kind; texts that cannot hold one are not searched."""
    may = text.contains(_HINTS[kind]) if kind in _HINTS else text.rlike("[0-9]")
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    found = F.when(may, matches(text, FORMS[kind])).otherwise(none)
    return F.filter(found, lambda h: _valid(kind, h["value"]))


def _of_kind(k: int) -> Callable[[Column], Column]:
    def span(h: Column) -> Column:
        return F.struct(h["start"].alias("start"), F.lit(k).alias("kind"), h["stop"].alias("stop"), h["value"].alias("value"))

    return span


def _is_kind(k: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == k


def base_spans(df: DataFrame, text: Column, name: str = "base") -> DataFrame:
    """`df` with the base spans of `text` as `name`: start, kind, stop, value; by start, then kind."""
    steps = {f"_{kind}": _hits(text, kind) for kind in KINDS}
    df = df.withColumns(steps)
    parts = [F.transform(f"_{kind}", _of_kind(k)) for k, kind in enumerate(KINDS)]
    return df.withColumn(name, F.array_sort(F.concat(*parts))).drop(*steps)


def _contexts(text: Column, pieces: Column, start: Column, stop: Column) -> Column:
    """Patterns of a place: the two words before it, and the words on either side, all of them whole."""
    before, after = F.substr(text, F.lit(1), start), F.substr(text, stop + 1, F.char_length(text))
    for left, right in reversed(WINDOWS):
        near = cut_pieces(pieces, F.greatest(start - left, F.lit(0)), start)
        before = F.when((start <= left) | near.rlike(r"(?<=\s)\S++\s++\S++\s*+$"), near).otherwise(before)
        near = cut_pieces(pieces, stop, stop + right)
        after = F.when((F.char_length(near) < right) | near.rlike(r"^\s*+\S++\s"), near).otherwise(after)
    before, after = F.lower(before), F.lower(after)
    # A word is entered at its start only and never given back, so long ones stay linear.
    two = F.regexp_extract(before, r"(?<!\S)(\S++\s++\S++)\s*+$", 1)
    one = F.regexp_extract(before, r"(?<!\S)(\S++)\s*+$", 1)
    following = F.regexp_extract(after, r"^\s*+(\S++)", 1)
    return F.array(
        F.when(two != "", F.concat(F.lit("before "), two)),
        F.when((one != "") & (following != ""), F.concat(F.lit("around "), one, F.lit(" _ "), following)),
    )


def _occurrences(read: DataFrame) -> DataFrame:
    """One narrow row per place and pattern: row, kind (null for a candidate), start, stop, value, pattern."""
    places = read.select("row", F.explode("places").alias("p"))
    return places.select(
        "row", "p.kind", "p.start", "p.stop", F.lower("p.value").alias("value"), F.explode("p.patterns").alias("pattern")
    ).filter("pattern IS NOT NULL")


def read_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: row, id, place, base spans, and all places with their patterns."""
    text = F.col("_text")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        seeded("place", F.col(f"`{id_col}`"), whole_text(text_col)).alias("place"),
        whole_text(text_col).alias("_text"),
    )
    rows = base_spans(rows, text)
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    loose = F.when(text.rlike("[0-9@]"), matches(text, IDENTIFIER)).otherwise(none)
    pieces = F.when(text.rlike("[0-9@]"), text_pieces(text))
    rows = settled_columns(rows, _loose=loose, _pieces=pieces)
    free = F.when(F.size("_loose") > 0, free_of(F.col("_loose"), F.col("base"))).otherwise(none)

    def place(h: Column, kind: Column) -> Column:
        return F.struct(
            kind.alias("kind"), h["start"].alias("start"), h["stop"].alias("stop"), h["value"].alias("value"),
            _contexts(text, F.col("_pieces"), h["start"], h["stop"]).alias("patterns"),
        )

    places = F.concat(
        F.transform("base", lambda b: place(b, b["kind"])), F.transform(free, lambda h: place(h, F.lit(None).cast("int")))
    )
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop")))
    return rows.select("row", "id", "place", plain.alias("base"), places.alias("places"))


def bootstrap(
    seen: DataFrame, rounds: int | None = None, min_support: int = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE, min_belief: float = MIN_BELIEF,
) -> DataFrame:
    """Places that trusted patterns and values single out: row, kind, start, stop.

    `seen` has a row per place and pattern. Patterns and values form a graph whose edges are
    counted once each. In each round a pattern's confidence in a kind is the share of trusted
    values of that kind among the different values in its slot, if `min_support` of them are
    trusted; the belief in a value is 1 - product of (1 - confidence) over its trusted patterns, and
    values with `min_belief` join the trusted ones. Rounds end when one adds no value, or after
    `rounds` if that is given. All is sums per key, so that frequent patterns
    and values are one row per task before they are shuffled.
    """
    edges = settle(seen.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "edges")
    trusted = edges.filter("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind"))
    totals = edges.groupBy("pattern").agg(F.count("*").alias("values"))
    patterns = None
    for _ in itertools.count() if rounds is None else range(rounds):
        known = settle(trusted, "trusted")
        of_kind = (
            edges.select("pattern", "value").join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("support"))
        )
        rated = of_kind.filter(F.col("support") >= min_support).join(totals, "pattern").select(
            "pattern", "kind", (F.col("support") / F.col("values")).alias("confidence")
        )
        patterns = settle(rated.filter(F.col("confidence") >= min_confidence), "patterns")
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        believed = (
            edges.select("pattern", "value")
            .join(patterns, "pattern")
            .join(known.select("value"), "value", "left_anti")
            .groupBy("value", "kind")
            .agg((1 - F.exp(doubt)).alias("belief"))
            .filter(F.col("belief") >= min_belief)
        )
        best = believed.groupBy("value").agg(F.min(F.struct((-F.col("belief")).alias("b"), "kind"))["kind"].alias("kind"))
        fresh = settle(best, "fresh")
        trusted = known.unionByName(fresh)
        if not fresh.limit(1).count():
            break
    final = settle(trusted, "trusted")
    open_places = seen.filter("kind IS NULL").drop("kind")
    return (
        open_places.join(patterns, "pattern")
        .join(final.withColumnRenamed("kind", "of_value"), "value")
        .filter("kind = of_value")
        .select("row", "kind", "start", "stop")
        .distinct()
    )


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Spans of personal data; one row per row of `docs`: row, id, place, base, extra.

    `base` and `extra` are arrays of (start, kind, stop) by start, then kind; kind is an index into
    `KINDS`, places count code points, stop is exclusive. Extra spans never overlap base spans. A
    null text counts as empty and has none; null and repeated ids and other columns are no
    matter; no rows give no rows. Texts are read once; all later steps see only the places.
    """
    read = settle(read_texts(docs, id_col, text_col), "places")
    extra = bootstrap(_occurrences(read), **options)
    per_row = extra.groupBy(F.col("row").alias("_row")).agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("extra")
    )
    none = F.array().cast(f"array<struct<{_SPAN.replace(' INT', ':int').replace(', ', ',')}>>")
    return read.join(per_row, F.col("row") == F.col("_row"), "left").select(
        "row", "id", "place", "base", F.coalesce("extra", none).alias("extra")
    )


def spans_text(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def mask(pieces: Column, spans: Column, size: Column) -> Column:
    """The text of `size` code points, cut to pieces, with each span replaced by the mask of its kind.

    Spans that overlap become one.
    """
    masks = F.array(*[F.lit(m) for m in MASKS])
    # One more span of no length at the end brings what is left of the text.
    end = F.struct(size.alias("start"), F.lit(len(MASKS)).alias("kind"), size.alias("stop"))

    def emit(at: Column, s: Column) -> Column:
        put = F.array(cut_pieces(pieces, at, s["start"]), F.coalesce(F.get(masks, s["kind"]), F.lit("")))
        return F.when(s["start"] >= at, put).otherwise(F.array().cast("array<string>"))

    kept = gathered(F.concat(spans, F.array(end)), F.lit(0), lambda at, s: F.greatest(at, s["stop"]), emit, "string")
    return F.array_join(kept, "")


def mask_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with personal data masked in `text_col`; other columns and rows stay. A null text becomes ''.

    Base spans are found again in place, so only the rows with extra spans are sent to their texts.
    """
    found = find_personal(docs, id_col, text_col, **options)
    more = (
        found.filter(F.size("extra") > 0)
        .groupBy(F.col("place").alias("_place"))
        .agg(F.first("extra").alias("_extra"))
    )
    text = F.coalesce(F.col("_doc")[text_col], F.lit(""))
    keyed = wrapped(docs).withColumns({"_at": seeded("place", F.col("_doc")[id_col], text), "_text": text})
    joined = base_spans(keyed.join(more, F.col("_at") == F.col("_place"), "left"), F.col("_text"), "_base")
    plain = F.transform("_base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop")))
    spans = F.when(F.col("_extra").isNull(), plain).otherwise(F.array_sort(F.concat(plain, F.col("_extra"))))
    some = F.size("_spans") > 0
    rows = settled_columns(joined, _spans=spans)
    rows = settled_columns(rows, _pieces=F.when(some, text_pieces(F.col("_text"))))
    masked = F.when(some, mask(F.col("_pieces"), F.col("_spans"), F.char_length("_text"))).otherwise(F.col("_text"))
    return unwrapped(rows, docs.columns, **{text_col: masked})


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [
        F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)
    ]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )

