"""Removal of multi-line passages that occur elsewhere, in DataFrame operations only.

Lines are cut into chunks where their content says so. A hash rolls over the hashes of
every two neighbouring lines; one part of it tells whether a chunk may start with the
first of them, another whether one may end with the second. Both edges of a chunk thus
depend on its own lines alone, so a passage yields the same chunks whatever stands around
it. Nearly all places are edges, for a chunk must not be longer than the shortest passage
to be found; the few that are not are made up for by RULES independent cuts, each with
its own parts of the hash, whose chunks overlap. Blank lines are passed over: they belong
to a chunk if they stand inside it.

1. Chunks are compared by digest, (document, first line, last line, digest), which leaves
   of a passage that very many documents hold one row per scan task before the shuffle.
2. The bodies of first copies, one per repeated digest, are sent to the other copies and
   compared byte by byte with what stands there.
3. The lines of all repeats of a document, taken together, are cut out of its text.

A passage of two lines is a chunk of its own with probability 0.998, and one of four
lines goes whole with 0.996: an edge is missed by a rule in 1 - (15/16) ** 2 of all places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectspark.llm.tables import row_key
from effectspark.sources.store import Stored, Workspace

# Fixed values of the cut: a place is no edge if its digit of the rolling hash is NO_EDGE (one in 16).
RULES = 3
NO_EDGE = "0"
REPEAT_BYTES = 96  # of a first copy in a broadcast: key, digest, two places, and what rows take
LONGEST = 5  # lines of a chunk that are not blank, where no end comes earlier
NOT_BLANK = r"[^\x20\x09-\x0D]"

_DIGEST = "unhex(md5({}))"

_P = "__line_dedup_"
_KEY, _LINES, _GONE = _P + "key", _P + "lines", _P + "gone"


def dedup_lines(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and their numbers.

    A chunk has two lines or more that are not blank. Of equal chunks the first by
    (doc_id, position) stays, also within a document; a NULL doc_id comes last. All lines
    of the others go, so each line that goes equals an earlier one, and a line of which
    there is no earlier copy stays.

    Adds ``n_lines``, ``n_removed`` (lines) and ``n_chunks_removed``; a column of
    that name in ``docs`` is replaced. Every row stays, with an empty text if nothing is
    left; a NULL text stays NULL and has no lines. Rows equal in doc_id and text are one
    document, so one is not a repeat of the other. An empty table gives no rows.
    """
    keyed = docs.withColumn(_KEY, F.unhex(row_key()))
    meta = ws.save(_chunk_rows(keyed), "chunks").df
    copies = (
        meta.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first <> last")
    )
    stored = ws.save(copies.select("digest", "first"), "repeated-chunks")
    repeats = stored.df
    bodies = _bodies(keyed, stored, ws)
    cut = (
        meta.join(repeats, "digest")
        .filter("first <> place")
        .select(F.col("place.key").alias(_KEY), "place.start", "place.stop", "digest")
        .join(bodies, "digest")
        .groupBy(_KEY)
        .agg(F.collect_set(F.struct("start", "stop", "body")).alias(_GONE))
    )
    split = F.when(F.col("text").isNotNull(), F.split("text", "\n", -1))
    found = keyed.join(cut, _KEY, "left").withColumn(_LINES, split)
    equal = f"filter({_GONE}, c -> {_body('c.start', 'c.stop')} = c.body)"
    found = found.withColumn(_GONE, F.expr(f"CASE WHEN {_GONE} IS NOT NULL THEN {equal} END"))
    lines = f"array_distinct(flatten(transform({_GONE}, c -> sequence(c.start, c.stop))))"
    found = found.withColumn(_P + "cut", F.expr(f"CASE WHEN size({_GONE}) > 0 THEN {lines} END"))
    kept = f"array_except(sequence(0, size({_LINES}) - 1), {_P}cut)"
    results = {
        "n_lines": F.expr(f"CASE WHEN {_LINES} IS NULL THEN 0L ELSE CAST(size({_LINES}) AS BIGINT) END"),
        "n_removed": F.expr(f"CASE WHEN {_P}cut IS NULL THEN 0L ELSE CAST(size({_P}cut) AS BIGINT) END"),
        "n_chunks_removed": F.expr(f"CASE WHEN {_P}cut IS NULL THEN 0L ELSE CAST(size({_GONE}) AS BIGINT) END"),
        "text": F.expr(
            f"CASE WHEN {_P}cut IS NULL THEN text ELSE array_join(transform({kept}, i -> {_LINES}[i]), '\n') END"
        ),
    }
    return found.withColumns(results).select(*dict.fromkeys([*docs.columns, *results]))


def _body(start: str, stop: str) -> str:
    return f"array_join(slice({_LINES}, {start} + 1, {stop} - {start} + 1), '\n')"


def _chunk_rows(keyed: DataFrame) -> DataFrame:
    """A row per chunk: place (with the document's key, the first and the last line) and digest.

    Each step is a projection of its own, so that a text is split once and not once per chunk.
    """
    rows = keyed.select("doc_id", _KEY, F.split("text", "\n", -1).alias(_LINES)).filter(F.col(_LINES).isNotNull())
    rows = rows.withColumn(
        "filled", F.expr(f"filter(sequence(0, size({_LINES}) - 1), i -> {_LINES}[i] RLIKE r'{NOT_BLANK}')")
    )
    rows = rows.withColumn("hashes", F.expr(f"transform(filled, i -> md5({_LINES}[i]))"))
    pairs = "arrays_zip(slice(hashes, 1, greatest(size(hashes) - 1, 0)), slice(hashes, 2, size(hashes)))"
    rows = rows.withColumn("rolled", F.expr(f"transform({pairs}, z -> md5(concat(z['0'], z['1'])))")).drop("hashes")
    each = rows.withColumn("ranges", F.expr(f"array_distinct(flatten(array({', '.join(_ranges(r) for r in range(RULES))})))"))
    chunk = f"named_struct('start', z.a, 'stop', z.b, 'digest', {_DIGEST.format(_body('z.a', 'z.b'))})"
    chunks = each.select("doc_id", _KEY, F.expr(f"transform(ranges, z -> {chunk})").alias("chunks"))
    # the outer form: from the inner one the optimiser derives a filter that computes the chunks once more
    flat = chunks.select("doc_id", _KEY, F.explode_outer("chunks").alias("c")).filter("c IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(_KEY).alias("key"), "c.start", "c.stop")
    return flat.select(place.alias("place"), "c.digest")


def _ranges(rule: int) -> str:
    """(a, b): first and last line of each chunk of one rule, over ``filled`` and ``rolled``."""
    starts = f"filter(sequence(0, size(rolled) - 1), i -> substr(rolled[i], {2 * rule + 1}, 1) != '{NO_EDGE}')"
    # the end of the text ends a chunk as well: there is no hash, hence NULL
    ends = lambda d: f"coalesce(substr(get(rolled, i + {d}), {2 * rule + 2}, 1), 'x') != '{NO_EDGE}' OR i + {d + 1} >= size(rolled)"
    last = " ".join(f"WHEN {ends(d)} THEN filled[i + {d + 1}]" for d in range(LONGEST - 2))
    one = f"named_struct('a', filled[i], 'b', CASE {last} ELSE filled[i + {LONGEST - 1}] END)"
    none = "CAST(array() AS array<struct<a: int, b: int>>)"
    return f"CASE WHEN size(rolled) = 0 THEN {none} ELSE transform({starts}, i -> {one}) END"


def _bodies(keyed: DataFrame, repeats: Stored, ws: Workspace) -> DataFrame:
    """(digest, body): the first copy of each repeated chunk.

    While the list of first copies can be broadcast, no text moves for it.
    """
    first = F.struct("digest", "first.start", "first.stop")
    wanted = repeats.df.groupBy(F.col("first.key").alias(_KEY)).agg(F.collect_list(first).alias("firsts"))
    wanted = F.broadcast(wanted) if repeats.rows * REPEAT_BYTES <= ws.broadcast_bytes else wanted
    # a chunk has two lines
    held = keyed.select(_KEY, "text").filter(F.col("text").contains("\n")).join(wanted, _KEY)
    lines = held.select(F.split("text", "\n", -1).alias(_LINES), "firsts")
    bodies = F.expr(f"transform(firsts, c -> named_struct('digest', c.digest, 'body', {_body('c.start', 'c.stop')}))")
    # rows of one key are one document
    return lines.select(F.inline(bodies)).dropDuplicates(["digest"])
