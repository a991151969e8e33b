"""Records of delimited files of any schema, with quoted cells that hold line breaks.

A file is read as lines, by blocks, in parallel. Whether a block begins inside a quoted cell
is not known to the task that reads it, so each block is followed under both assumptions: what
it makes of either is a function on two states, and a prefix over a file's blocks composes these
functions, which gives every block's true beginning. Most blocks forget their beginning at their
first quoted line; from there on records are put together in the task. Only the lines before
that, and records that lie across blocks, are decided and joined afterwards.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraprofile.session import materialize

# a line of whole cells: nothing is left open behind it
_CELL = r'(?: *"(?:[^"]|"")*" *|[^",;\t|]*)'
WHOLE_LINE = rf"^{_CELL}(?:[,;\t|]{_CELL})*\r?$"
OUTSIDE, INSIDE, CLOSED = 0, 1, 2
# stands for a separator inside quotes while a record is cut; no character of any text
MASK = "\ufdd0"
BROADCAST_BLOCKS = 1_000_000
BATCH_BYTES = 1 << 22


def after_line(line: str, inside: int) -> int:
    """Whether a quoted cell is open behind ``line``, if one was open before it or not.

    A quote opens a cell at the cell's start only and closes it anywhere; doubled quotes stay
    inside. Any of the four separators begins a cell, as a block does not know its file's.
    """
    state, first = (INSIDE if inside else OUTSIDE), not inside
    for text in line.split('"')[:-1]:
        bare = text.rstrip(" ")
        if state == INSIDE:
            state = CLOSED
        elif state == CLOSED and text == "":
            state = INSIDE
        elif (first and bare == "") or bare[-1:] in (",", ";", "\t", "|"):
            state = INSIDE
        else:
            state = OUTSIDE
        first = False
    return int(state == INSIDE)


def _lines(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    text = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("lineSep", "\n").text(directory)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _walk(batches):
    """Per run of lines of one block: path, block, first line's number, lines, and for each quoted line its place, and whether it is whole."""
    at, n = None, 0
    for batch in batches:
        paths, blocks = batch.column(0), batch.column(1)
        same = pc.and_(pc.equal(paths.slice(1), paths.slice(0, len(paths) - 1)), pc.equal(blocks.slice(1), blocks.slice(0, len(blocks) - 1)))
        turns = [0, *(k + 1 for k in pc.indices_nonzero(pc.invert(same)).to_pylist()), batch.num_rows] if batch.num_rows else []
        for start, end in zip(turns, turns[1:]):
            key = (paths[start].as_py(), blocks[start].as_py())
            if key != at:
                at, n = key, 0
            values = batch.column(2).slice(start, end - start)
            quoted = pc.indices_nonzero(pc.match_substring(values, '"')).to_pylist()
            whole = pc.match_substring_regex(values.take(pa.array(quoted, pa.int64())), WHOLE_LINE).to_pylist() if quoted else []
            yield key, n, values, list(zip(quoted, whole))
            n += end - start


def _summaries(batches):
    """One row per run of lines of a block: what it makes of both beginnings, and the file's first line."""
    out = []
    for (path, block), n, values, quoted in _walk(batches):
        s0, s1 = 0, 1
        for k, whole in quoted:
            if s0 == s1 == 0 and whole:
                continue
            line = values[k].as_py()
            s0, s1 = (0 if whole and not s0 else after_line(line, s0)), (0 if whole and not s1 else after_line(line, s1))
        out.append((path, block, n, s0, s1, values[0].as_py() if block == 0 and n == 0 else None))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    names = ["path", "block", "n", "s0", "s1", "head"]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def _composed(rows: DataFrame, keys: list[str], order: list[str], inclusive: bool) -> DataFrame:
    """The state behind (or before) each row if its group begins outside (``c0``) and inside (``c1``) a quoted cell.

    A row that maps both states to one resets all before it; of the others each either keeps or swaps the state.
    """
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("s0") == F.col("s1")
    swaps = F.coalesce(F.sum(F.when(~fixed & (F.col("s0") == 1), 1).otherwise(0)).over(whole), F.lit(0))
    marked = rows.withColumn("swaps", swaps)
    last = F.last(F.when(fixed, F.struct("s0", "swaps")), ignorenulls=True).over(frame)
    now = F.coalesce(F.last("swaps").over(frame), F.lit(0))
    reach = lambda begin: F.when(last.isNull(), (F.lit(begin) + now) % 2).otherwise((last["s0"] + now - last["swaps"]) % 2)
    return marked.withColumns({"c0": reach(0), "c1": reach(1)}).drop("swaps")


def block_states(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    """Per block: path, block, whether it begins inside a quoted cell (``start``), and the file's first line at block 0.

    A file's first block begins outside; the blocks of a file, not its lines, meet in one task.
    """
    ddl = "path string, block long, n long, s0 int, s1 int, head string"
    runs = _lines(spark, directory, glob).mapInArrow(_summaries, ddl)
    last = Window.partitionBy("path", "block").orderBy(F.col("n").desc())
    whole = _composed(runs, ["path", "block"], ["n"], True).withColumn("rank", F.row_number().over(last))
    blocks = whole.groupBy("path", "block").agg(
        F.max(F.when(F.col("rank") == 1, F.col("c0"))).alias("s0"), F.max(F.when(F.col("rank") == 1, F.col("c1"))).alias("s1"), F.max("head").alias("head")
    )
    return _composed(blocks, ["path"], ["block"], False).select("path", "block", F.col("c0").alias("start"), "head")


def _pieces(batches):
    """Whole records of a block as far as its beginning does not matter, else its lines with both states.

    Columns: path, block, n, value, b0 and a0 (states before and behind, beginning outside), b1 and a1.
    """
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 4]
    names = ["path", "block", "n", "value", "b0", "a0", "b1", "a1"]
    key, s0, s1, held, held_at, met, opened, out, size = None, 0, 1, [], 0, 0, 0, [], 0

    def batch():
        nonlocal out, size
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        out, size = [], 0
        return made

    def put(behind):
        """The lines held; they go on with a record that was open when the two beginnings met, or begin one."""
        nonlocal held
        before = opened if held_at == met else 0
        out.append((*key, held_at, "\n".join(held), before, behind, before, behind))
        held = []

    def close():
        """The rest of a record that goes on in the next block."""
        nonlocal held
        if held:
            put(1)

    for own, n, values, quoted in _walk(batches):
        if own != key:
            if key is not None:
                close()
            key, s0, s1, met, opened = own, 0, (0 if own[1] == 0 else 1), 0, 0
        whole_of = dict(quoted)
        for k, line in enumerate(values.to_pylist()):
            whole = whole_of.get(k)
            if whole is None:
                a0, a1 = s0, s1
            else:
                a0 = 0 if whole and not s0 else after_line(line, s0)
                a1 = 0 if whole and not s1 else after_line(line, s1)
            if s0 != s1:
                out.append((*key, n + k, line, s0, a0, s1, a1))
            elif s0 == 0 and a0 == 0:
                out.append((*key, n + k, line, 0, 0, 0, 0))
            else:
                if not held:
                    held_at = n + k
                held.append(line)
                if a0 == 0:
                    put(0)
            if s0 != s1 and a0 == a1:
                met, opened = n + k + 1, a0
            s0, s1 = a0, a1
            size += len(line)
            if size >= BATCH_BYTES and out:
                yield batch()
    if key is not None:
        close()
    if out:
        yield batch()


def join_torn(known: DataFrame, seam: str = "\n") -> DataFrame:
    """Records that lie across blocks, from pieces (path, block, n, value, before, behind): where they begin, value, broken.

    Only pieces that go on from or into another are taken: few, at the ends of blocks. A record that
    the end of the file leaves open is ``broken``, with the text of its first piece.
    """
    by_file = Window.partitionBy("path").orderBy("block", "n")
    torn = known.where("before = 1 OR behind = 1").withColumn("record", F.sum(F.when(F.col("before") == 0, 1).otherwise(0)).over(by_file))
    bits = F.sort_array(F.collect_list(F.struct("block", "n", "value")))
    open_ = F.max_by("behind", F.struct("block", "n")) == 1
    joined = torn.groupBy("path", "record").agg(bits.alias("bits"), open_.alias("broken"))
    text = F.when(F.col("broken"), F.col("bits")[0]["value"]).otherwise(F.array_join(F.transform("bits", lambda b: b["value"]), seam))
    return joined.select("path", F.col("bits")[0]["block"].alias("block"), F.col("bits")[0]["n"].alias("n"), text.alias("value"), "broken")


def records(spark: SparkSession, directory: str, glob: str = "*.{csv,txt}") -> tuple[DataFrame, DataFrame]:
    """The first line of each file (path, head), and all records but blank ones: path, first, value, broken.

    ``first`` marks a file's first record, its header. ``broken`` marks a record whose quoted cell is
    open at the end of its file; its text is then the piece where it begins.
    """
    states = materialize(block_states(spark, directory, glob), "block-states")
    heads = states.where("block = 0").select("path", "head")
    inside = states.where("start = 1 AND block > 0").select("path", "block", F.lit(1).alias("start"))
    # rows per block, so small beside the data; broadcast only where counted
    if inside.count() <= BROADCAST_BLOCKS:
        inside = F.broadcast(inside)
    pieces = _lines(spark, directory, glob).mapInArrow(_pieces, "path string, block long, n long, value string, b0 int, a0 int, b1 int, a1 int")
    known = pieces.join(inside, ["path", "block"], "left")
    begins = F.col("start").isNotNull()
    known = known.select("path", "block", "n", "value", F.when(begins, F.col("b1")).otherwise(F.col("b0")).alias("before"), F.when(begins, F.col("a1")).otherwise(F.col("a0")).alias("behind"))
    # whole records and torn ones are both taken from these, so the text is walked once for them
    known = materialize(known, "record-pieces")
    whole = known.where("before = 0 AND behind = 0").select("path", ((F.col("block") == 0) & (F.col("n") == 0)).alias("first"), "value", F.lit(False).alias("broken"))
    # the header is whatever begins at a file's beginning
    joined = join_torn(known).select("path", ((F.col("block") == 0) & (F.col("n") == 0)).alias("first"), "value", "broken")
    every = whole.unionByName(joined)
    return heads, every.select("path", "first", F.regexp_replace("value", "^\ufeff|\r$", "").alias("value"), "broken").where("trim(value) <> ''")


def cells(value: Column, delimiter: Column) -> Column:
    """The cells of a record: quotes around a cell taken off, doubled ones halved, ends trimmed."""

    def marked(acc: Column, text: Column) -> Column:
        bare = F.rtrim(text)
        inside = acc["state"] == INSIDE
        opens = ((acc["flags"] == "") & (bare == "")) | bare.endswith(delimiter) | ((acc["state"] == CLOSED) & (text == ""))
        state = F.when(inside, CLOSED).when(opens, INSIDE).otherwise(OUTSIDE)
        return F.struct(state.alias("state"), F.concat(acc["flags"], F.when(inside, "I").otherwise("O")).alias("flags"))

    bits = F.split(value, '"', -1)
    flags = F.aggregate(bits, F.struct(F.lit(OUTSIDE).alias("state"), F.lit("").alias("flags")), marked)["flags"]
    masked = F.array_join(F.transform(bits, lambda b, i: F.when(F.substring(flags, i + 1, F.lit(1)) == "I", F.replace(b, delimiter, F.lit(MASK))).otherwise(b)), '"')
    whole = lambda c: F.replace(F.regexp_extract(c, r'(?s)^"(.*)"$', 1), F.lit('""'), F.lit('"'))
    plain = lambda c: F.when(c.rlike(r'(?s)^".*"$'), whole(c)).otherwise(c)
    pattern = F.when(delimiter == "|", F.lit("\\|")).otherwise(delimiter)
    quoted = F.transform(F.split(masked, pattern, F.lit(-1)), lambda c: plain(F.trim(F.replace(c, F.lit(MASK), delimiter))))
    return F.when(F.contains(value, F.lit('"')), quoted).otherwise(F.transform(F.split(value, pattern, F.lit(-1)), lambda c: F.trim(c)))
