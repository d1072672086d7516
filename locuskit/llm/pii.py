"""Personal data by bootstrapped contexts, in DataFrame expressions only.

Seeds are spans that fixed shapes find (emails, addresses, cards, phones, long keys). What
stands left of a span is its lexical pattern. Patterns and identifiers form a bipartite
graph, one edge per distinct pair; a few rounds score patterns by the share of their
identifiers that have a kind, and unlabelled identifiers by their best pattern. Patterns of
high confidence then label the identifiers that no shape knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuskit.llm.common import prepare, stored, with_row

#: In the marked text a lone blank or dash between digits is U+0001 and a dot between name
#: characters is U+0002: runs then are single character classes, which match without recursion.
_RUN = r"(?<=[0-9])[\x20-](?=[0-9])"
_DOT = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
_LOCAL = r"[A-Za-z0-9._%+\x01\x02-]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Kinds of the base detection, in the order of equal starts, then the seeds the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
_IDENT = r"[A-Za-z0-9_@.\x02-]"
#: An unlabelled identifier: a run of at least six characters with two digits.
IDENTIFIER = rf"(?<!{_IDENT})(?={_IDENT}*?[0-9]{_IDENT}*?[0-9]){_IDENT}{{6,}}+"
#: A pattern is looked for in so many pieces between blanks, each whole, left of a span.
PIECES = 8
ONE_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string,left:string>"
SPAN = f"array<{ONE_SPAN}>"
#: Arrays are folded in blocks of so many items.
BLOCK = 256
#: Above every offset in a text.
FAR = 2**31 - 1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    worth = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _card(value: Column) -> Column:
    return F.length(_digits(value)).between(14, 19) & _luhn(_digits(value))


def _ip(value: Column) -> Column:
    return value.rlike(rf"^{_PART}(?:[.\x02]{_PART}){{3}}$")


#: kind: pattern on its marked text, and the test a match must pass.
SHAPES = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++\x02[A-Za-z0-9\x02-]++", lambda v: F.lit(True)),
    "ip": (r"(?<![0-9])[0-9]++(?:[.\x02][0-9]++){3}", _ip),
    "card": (r"[0-9][0-9\x01]*[0-9]", _card),
    "phone": (r"\+[0-9][\x20().0-9\x02-]+[0-9]", lambda v: F.length(_digits(v)).between(10, 15)),
    "secret": (r"(?<![0-9A-Za-z])(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{32,}+(?![0-9A-Za-z])", lambda v: F.lit(True)),
}


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _cut(items: Column, use) -> Column:
    """``use`` of each block of at most ``BLOCK`` items; ``items`` must not be empty."""
    return F.transform(F.sequence(F.lit(1), F.size(items), F.lit(BLOCK)), lambda first: use(F.slice(items, first, F.lit(BLOCK))))


def _running(values: Column, op) -> Column:
    """The running sums, or greatest values, of an array of ints of at least 0, each with its own value.

    A fold copies its state at every step. So blocks are folded apart, then their last values, and
    the cost of n values grows with n times the number of blocks and the length of one, not with n squared.
    """
    none, zero = F.array().cast("array<int>"), F.lit(0)

    def folded(numbers):
        return F.aggregate(numbers, none, lambda acc, x: F.concat(acc, F.array(op(
            F.coalesce(F.try_element_at(acc, F.lit(-1)), zero), x).cast("int"))))

    def joined(blocks):
        before = F.concat(F.array(zero), folded(F.transform(blocks, lambda b: F.element_at(b, -1))))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)),
                                    lambda b, first: F.transform(b, lambda x: op(first, x).cast("int"))))
    return _once(values, lambda v: F.when(F.size(v) > 0, _once(_cut(v, folded), joined)).otherwise(none))


def _spans(text: Column, pattern: str, kind: str, rank: int, good) -> Column:
    """Matches that pass ``good``, with their offsets in code points and what stands left of them."""
    def placed(hits):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("value")))
        return _once(pairs, lambda all_: F.zip_with(all_, _running(F.transform(all_, lambda p: (
            F.char_length(p["gap"]) + F.char_length(p["value"])).cast("int")), lambda x, y: x + y), span))

    def span(p, end):
        return F.struct((end - F.char_length(p["value"])).cast("int").alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
                        F.lit(kind).alias("kind"), p["value"].alias("value"), F.substring_index(p["gap"], " ", -PIECES).alias("left"))
    none = F.array().cast(SPAN)
    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(
        F.size(hits) > 0, F.filter(placed(hits), lambda s: good(s["value"])).cast(SPAN)).otherwise(none))


def _free(seeds: Column, found: Column) -> Column:
    """The spans of ``found``, which do not overlap each other, that no seed overlaps.

    All stand in one order by start, seeds first: none of the seeds before may end behind the
    span's start, and the next seed behind it may not start before its end.
    """
    def start_from_far(s):  # the nearer the start of the text, the larger; 0 for others
        return F.when(s["kind"] != "other", F.lit(FAR) - s["start"]).otherwise(0).cast("int")

    def chosen(both):
        ends = F.transform(both, lambda s: F.when(s["kind"] != "other", s["end"]).otherwise(0).cast("int"))
        cover = _running(ends, F.greatest)
        following = F.reverse(_running(F.transform(F.reverse(both), start_from_far), F.greatest))
        marks = F.zip_with(cover, following, lambda c, n: F.struct(c.alias("cover"), (F.lit(FAR) - n).alias("next")))
        rows = F.zip_with(both, marks, lambda s, m: F.struct(s.alias("s"), m.alias("m")))
        return F.transform(F.filter(rows, lambda r: (r["s"]["kind"] == "other") & (r["m"]["cover"] <= r["s"]["start"])
                                    & (r["m"]["next"] >= r["s"]["end"])), lambda r: r["s"])
    return _once(F.sort_array(F.concat(seeds, found)), chosen).cast(SPAN)


def _patterns(left: Column) -> Column:
    """The last word with the marks behind it, and the last two words with theirs."""
    low = F.lower(F.translate(left, "\x01\x02", " ."))
    one = F.regexp_extract(low, r"((?<!\p{L})\p{L}++[^\p{L}0-9]*+)$", 1)
    two = F.regexp_extract(low, r"((?<!\p{L})\p{L}++[^\p{L}0-9]++\p{L}++[^\p{L}0-9]*+)$", 1)
    return F.filter(F.array_distinct(F.array(one, two)), lambda p: F.char_length(p) > 1)


def extracted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with pii_seeds (all shapes' spans by start, then kind) and pii_others.

    No shuffle. Only texts with a digit or an @ are searched. pii_others are identifiers
    that no seed overlaps.
    """
    whole = F.translate(F.coalesce(F.col(text), F.lit("")), "\x01\x02", "\x03\x03")
    none = F.array().cast(SPAN)
    own = [f"`{c}`" for c in docs.columns]
    rows = docs.select(*own, F.when(whole.rlike("[0-9@]"), whole).alias("pii_text"))
    rows = rows.select(*own, "pii_text", F.regexp_replace("pii_text", _RUN, "\x01").alias("pii_runs"),
                       F.regexp_replace("pii_text", _DOT, "\x02").alias("pii_dots"))
    source = {"card": "pii_runs", "phone": "pii_text"}
    seeds = F.concat(*[_spans(F.col(source.get(k, "pii_dots")), SHAPES[k][0], k, i, SHAPES[k][1])
                       for i, k in enumerate(KINDS)])
    others = _spans(F.col("pii_dots"), IDENTIFIER, "other", len(KINDS), lambda v: F.lit(True))
    rows = rows.select(*own, F.when(F.col("pii_text").isNotNull(), F.sort_array(seeds)).alias("pii_seeds"),
                       F.when(F.col("pii_text").isNotNull(), others).alias("pii_found"))
    return rows.select(*own, F.coalesce("pii_seeds", none).alias("pii_seeds"),
                       F.when(F.size("pii_found") > 0, _free(F.col("pii_seeds"), F.col("pii_found"))).otherwise(none).alias("pii_others"))


def _edges(rows: DataFrame) -> DataFrame:
    """(pattern, value, kind) once each; kind is null for identifiers of no shape."""
    every = rows.select(F.explode(F.concat("pii_seeds", "pii_others")).alias("s"))
    kind = F.when(F.col("s.kind") != "other", F.col("s.kind"))
    return every.select(F.explode(_patterns(F.col("s.left"))).alias("pattern"),
                        F.xxhash64(F.col("s.kind"), F.col("s.value")).alias("value"), kind.alias("kind")).distinct()


def _scored_patterns(edges: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(pattern, kind, score): the smoothed share of a pattern's identifiers that have its best kind."""
    sums = edges.select("pattern", "value").join(labels, "value", "left").groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in KINDS])
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("sum"), F.lit(-i).alias("order"), F.lit(k).alias("kind"))
                                 for i, k in enumerate(KINDS)]))
    rows = sums.select("pattern", best.alias("b"), "n")
    return rows.select("pattern", F.col("b.kind").alias("kind"),
                       (F.col("b.sum") / (F.col("n") + 2)).alias("score")).filter(F.col("score") >= least)


def pattern_scores(edges: DataFrame, rounds: int = 3, spread: float = 0.5, confident: float = 0.8) -> DataFrame:
    """Confident patterns after some rounds over the graph; seeds keep score 1 throughout.

    With n identifiers of one kind a pattern scores n / (n + 2), so ``confident`` 0.8 needs
    eight pure ones. All steps are joins and sums of distinct edges with map-side partial sums.
    """
    seeds = edges.filter("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    labels = seeds
    for _ in range(rounds - 1):
        strong = _scored_patterns(edges, labels, spread)
        reached = edges.filter("kind is null").select("pattern", "value").join(strong, "pattern").groupBy("value").agg(
            F.max(F.struct("score", "kind")).alias("m")).select("value", "m.kind", "m.score")
        labels = stored(seeds.unionByName(reached), "pii_labels")
    return _scored_patterns(edges, labels, confident)


def personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), rounds: int = 3,
                  confident: float = 0.8) -> DataFrame:
    """(*keep, pii_spans): per row the spans (start, rank, end, kind, seed) by start, then kind.

    Offsets are code points, the end exclusive. Null and empty texts have no spans; repeated
    rows and null ids stay as they are; an empty table gives an empty result. A row's spans
    are one array, so its size is the number of identifiers in that text.
    """
    prepare(docs.sparkSession)
    rows = stored(with_row(extracted(docs.select(*{f"`{c}`": 0 for c in (*keep, text)}), text)
                           .select(*[f"`{c}`" for c in keep], "pii_seeds", "pii_others")), "pii")
    strong = stored(pattern_scores(stored(_edges(rows), "pii_edges"), rounds, confident=confident), "pii_patterns")
    other = rows.filter(F.size("pii_others") > 0).select("_row", F.explode("pii_others").alias("s"))
    near = other.select("_row", F.col("s.start").alias("start"), F.col("s.end").alias("end"),
                        F.explode(_patterns(F.col("s.left"))).alias("pattern")).join(strong, "pattern")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("m.kind")) - 1
    new = near.groupBy("_row", "start", "end").agg(F.max(F.struct("score", "kind")).alias("m")).select(
        "_row", F.struct("start", rank.cast("int").alias("rank"), "end", F.col("m.kind").alias("kind"), F.lit(False).alias("seed")).alias("s"))
    more = new.groupBy("_row").agg(F.collect_list("s").alias("pii_more"))
    known = F.transform("pii_seeds", lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(True).alias("seed")))
    kind = "array<struct<start:int,rank:int,end:int,kind:string,seed:boolean>>"
    return rows.join(more, "_row", "left").select(*[f"`{c}`" for c in keep], F.sort_array(F.concat(
        known.cast(kind), F.coalesce(F.col("pii_more").cast(kind), F.array().cast(kind)))).alias("pii_spans"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans are one.

    The spans are those of ``personal_data``, by start. The text is cut once for each block of
    spans, then inside the blocks, so that a very long text is not walked anew for every span.
    Null texts stay null, texts without spans as they are.
    """
    def replaced(block):
        """The text from the end of what is before the block to the end of the block's last tag."""
        first = block[0]["before"]
        return _once(F.substring(text, first + 1, F.element_at(block, -1)["start"] - first), lambda piece: F.array_join(F.transform(
            F.filter(block, lambda s: s["start"] >= s["before"]),
            lambda s: F.concat(F.substring(piece, s["before"] - first + 1, s["start"] - s["before"]), F.lit("<"), s["kind"], F.lit(">"))), ""))

    def whole(found):
        ends = _running(F.transform(found, lambda s: s["end"]), F.greatest)
        return _once(ends, lambda end: F.concat(
            _once(F.zip_with(found, F.slice(F.concat(F.array(F.lit(0)), end), F.lit(1), F.size(found)), lambda s, e: F.struct(
                s["start"].alias("start"), s["kind"].alias("kind"), e.alias("before"))),
                lambda spans: F.array_join(_cut(spans, replaced), "")),
            F.substring(text, F.element_at(end, -1) + 1, F.char_length(text))))
    return _once(spans, lambda found: F.when(F.size(found) > 0, whole(found)).otherwise(text))
