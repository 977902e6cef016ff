"""Sharding on a consistent-hash ring with virtual nodes and bounded loads; DataFrame operations only.

A shard has ``points`` virtual nodes on a ring of hash values. A row belongs to the arc that ends, going
clockwise, at the next virtual node. Shards have bounded loads: the numbers of rows that they may hold
differ by at most one and add up to all rows. At a virtual node the shard takes its own arc's rows, by
hash, as long as it has room, then rows that overflowed before; what is left continues clockwise. After
two rounds every row has its place, and every shard exactly its load.

A new shard takes its arcs, and every load falls by its share: rows that overflowed move with them, so more
moves than from a ring without bounds, and far less than from dealing anew (see the test).

The ring walk needs only the numbers of rows by arc (shards x points of them), folded by ``aggregate`` in
one row. A row finds its place by its rank in its arc: arcs are ranked in cells of the ring, whose
counts are summed, so that no window holds more than a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import _bytes as B

BITS = 40
CELLS = 14  # of hash bits
BLOCK = 48  # steps


def _ring(spark: SparkSession, shards: int, points: int) -> DataFrame:
    """node (0.. clockwise), shard, at (the end of its arc), since (the end of the arc before)."""
    shard, point = F.col("id") % shards, F.floor(F.col("id") / shards)  # a shard's points stay where they are when others come
    nodes = spark.range(shards * points).select(shard.cast("int").alias("shard"), F.shiftrightunsigned(F.xxhash64(F.lit("node"), shard, point), 64 - BITS).alias("at"), "id")
    by = Window.orderBy("at", "id")
    return nodes.select((F.row_number().over(by) - 1).alias("node"), "shard", "at", F.lag("at").over(by).alias("since"))


#: state: room by shard, what is carried, its number so far, and a record for each step
_STEP = """
named_struct(
  'room', transform(s.room, (r, i) -> if(i = x.shard, r - least(x.n, r) - least(s.carried, r - least(x.n, r)), r)),
  'carried', s.carried + x.n - least(x.n, s.room[x.shard]) - least(s.carried, s.room[x.shard] - least(x.n, s.room[x.shard])),
  'sent', s.sent + x.n - least(x.n, s.room[x.shard]),
  'taken', s.taken + least(s.carried, s.room[x.shard] - least(x.n, s.room[x.shard])),
  'steps', concat(s.steps, array(named_struct('node', x.node, 'shard', x.shard, 'home', least(x.n, s.room[x.shard]),
     'slot', s.load[x.shard] - s.room[x.shard], 'sent', s.sent, 'guests', least(s.carried, s.room[x.shard] - least(x.n, s.room[x.shard])), 'taken', s.taken))),
  'load', s.load)
"""


def assign(docs: DataFrame, shards: int = 24, points: int = 64) -> DataFrame:
    """Put every row of docs (doc_id, text) into a shard 0 to shards-1; the numbers of rows differ by at most one.

    Returns doc_id, size (UTF-8 bytes of the text and 8), text_crc32, law (``rows``), shard, slot (gapless
    from 0 in each shard) and grown_shard (null: loads, not the id alone, decide).

    The place on the ring is a hash of doc_id; rows that repeat an id have the same place and are ranked one
    after the other, by text. Rows without id are placed by a hash of their text and of where the scan finds
    them. Null text has 0 bytes and the crc32 of nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    # without an id the text decides, and its place in the scan, so that equal texts spread
    rows = rows.withColumn("__h", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("text_crc32", F.monotonically_increasing_id())))
    rows = B.cut(rows)  # a few numbers a row; counts and placement must see the same hashes, whatever is computed again
    rows = rows.withColumn("__at", F.shiftrightunsigned("__h", 64 - BITS)).withColumn("__cell", F.shiftrightunsigned("__at", BITS - CELLS).cast("int"))
    ring = _ring(spark, shards, points)
    # cells of the ring, cut at the nodes: a bounded table of where each begins and the arc it belongs to
    starts = spark.range(1 << CELLS).select(F.shiftleft("id", BITS - CELLS).alias("from"))
    starts = starts.unionByName(ring.select((F.col("at") + 1).alias("from"))).distinct().where(F.col("from") < F.lit(1 << BITS))
    marks = starts.select("from", F.lit(None).cast("int").alias("node"), F.lit(0).alias("o")).unionByName(ring.select(F.col("at").alias("from"), "node", F.lit(1).alias("o")))
    after = Window.orderBy("from", "o").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    piece = marks.withColumn("arc", F.coalesce(F.first("node", ignorenulls=True).over(after), F.lit(0))).where("o = 0")
    piece = piece.select("from", "arc", F.shiftrightunsigned("from", BITS - CELLS).cast("int").alias("cell"))
    cells = piece.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("from", "arc"))).alias("pieces"))
    within = F.expr("element_at(filter(pieces, p -> p.from <= __at), -1)")
    rows = rows.join(F.broadcast(cells), F.col("__cell") == F.col("cell")).withColumn("__p", within)
    rows = rows.select("doc_id", "size", "text_crc32", "__h", F.col("__p.from").alias("__from"), F.col("__p.arc").alias("__arc"))

    counts = rows.groupBy("__from", "__arc").agg(F.count("*").alias("n"))
    # going clockwise from 0; the arc over the end of the ring belongs to node 0 and its rows rank last there
    base = F.coalesce(F.sum("n").over(Window.partitionBy("__arc").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counts.select("__from", F.col("__arc").alias("arc2"), "n", base.alias("base"))
    arcs = counts.groupBy("__arc").agg(F.sum("n").alias("n"))
    arcs = ring.join(arcs, F.col("node") == F.col("__arc"), "left").select("node", "shard", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    once = arcs.agg(F.sort_array(F.collect_list(F.struct("node", "shard", "n"))).alias("x"), F.sum("n").alias("all"))
    load = f"transform(sequence(0, {shards - 1}), i -> cast(all div {shards} + if(i < all % {shards}, 1, 0) as long))"
    start = f"named_struct('room', {load}, 'carried', 0L, 'sent', 0L, 'taken', 0L, 'steps', cast(array() as array<struct<node:int,shard:int,home:long,slot:long,sent:long,guests:long,taken:long>>), 'load', {load})"
    again = "concat(x, transform(x, y -> named_struct('node', y.node, 'shard', y.shard, 'n', 0L)))"
    # block by block, so that a step copies the records of its block only
    block = f"transform(sequence(0, ({2 * shards * points} - 1) div {BLOCK}), b -> slice(y, b * {BLOCK} + 1, {BLOCK}))"
    fresh = "named_struct('room', t.room, 'carried', t.carried, 'sent', t.sent, 'taken', t.taken, 'steps', slice(t.steps, 1, 0), 'load', t.load)"
    within = f"aggregate(b, {fresh}, (s, x) -> {_STEP})"
    joined = "named_struct('room', i.room, 'carried', i.carried, 'sent', i.sent, 'taken', i.taken, 'steps', concat(t.steps, i.steps), 'load', i.load)"
    walked = f"aggregate(blocks, {start}, (t, b) -> aggregate(array({within}), t, (t, i) -> {joined})).steps"
    blocks = once.select(F.expr(f"{again} as y"), "all").selectExpr(f"{block} as blocks", "all")
    steps = blocks.select(F.posexplode(F.expr(walked)).alias("turn", "s")).select("turn", "s.*")
    first = steps.groupBy("node").agg(F.min_by(F.struct("shard", "home", "slot", "sent"), "turn").alias("f"))
    guests = steps.where("guests > 0").select("taken", "guests", F.col("shard").alias("gshard"), (F.col("slot") + F.col("home")).alias("gslot"))
    guests = guests.agg(F.sort_array(F.collect_list(F.struct("taken", "guests", "gshard", "gslot"))).alias("guests"))

    rank = F.row_number().over(Window.partitionBy("__from").orderBy("__h", "doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("__r", rank).join(F.broadcast(counted.select("__from", "base")), "__from").withColumn("__r", F.col("__r") + F.col("base"))
    placed = placed.join(F.broadcast(first), F.col("__arc") == F.col("node")).crossJoin(F.broadcast(guests))
    over = F.expr("f.sent + __r - f.home")  # its number among all that overflow
    placed = placed.withColumn("__g", F.when(F.expr("__r >= f.home"), F.expr("element_at(filter(guests, g -> g.taken <= f.sent + __r - f.home), -1)")))
    shard = F.coalesce("__g.gshard", "f.shard")
    slot = F.coalesce(F.col("__g.gslot") + over - F.col("__g.taken"), F.col("f.slot") + F.col("__r"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` in 24 shards."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
