"""Mixtures of sources by target weights, in blocks of words (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import running_sums
from .common import Workspace, text_or_empty, with_summary

#: Rounds of the permutation, and the rows that one task makes of one row.
ROUNDS, RUN = 24, 4096

KEY = ["no_source", "source"]


def hashed(*parts) -> Column:
    """60 bits of the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def permuted(i: Column, n: Column, seed: int, *key: Column) -> Column:
    """Where a pseudorandom permutation of 0 ... n - 1, one for each key, puts i.

    In each round i and (k - i) mod n change places or not, as a hash of the larger of the two says; k is the round's own."""

    def swapped(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(hashed(seed, "turn", *key, r), n) - x, n)
        return F.when(hashed(seed, "swap", *key, r, F.greatest(x, other)) % 2 == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), i.cast("long"), swapped)


def counted_out(df: DataFrame, n: str, name: str) -> DataFrame:
    """Each row n times, numbered by `name` from 0: in runs that are dealt to tasks before they are written out."""
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / RUN)))
    runs = df.where(F.col(n) > 0).withColumn("_run", run).repartition(*KEY, "_run")
    inside = F.sequence(F.col("_run") * RUN, F.least(F.col("_run") * RUN + RUN, F.col(n)) - 1)
    return runs.withColumn(name, F.explode(inside)).drop("_run")


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, size, no_source, source) of each row; a null source is '' with no_source = 1, which sorts last."""
    source = F.col(source_col).cast("string")
    size = F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return df.select(F.col(id_col).alias("doc_id"), size.alias("size"), source.isNull().cast("int").alias("no_source"), F.coalesce(source, F.lit("")).alias("source"))


def with_targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Sources (no_source, source, source_size, rows) with `weight` and `target`, their share of all words.

    Weights are dealt in the order of sources, over and over. A source stops at `most` times its words, and what it leaves is shared again by weight. Sources stop
    in the order of words by weight, so one pass of running sums in this order tells which: those for which the words still to
    share, by the weight still to share by, are as much as they can take.
    """
    place = running_sums(sources, KEY).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int")).cast("long"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    rest = running_sums(place.drop("position").withColumn("ratio", F.col("source_size") / F.col("weight")), ["ratio", *KEY], ["source_size", "weight"])
    whole = rest.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weights"))
    each = rest.crossJoin(F.broadcast(whole))  # one row
    words_left, weight_left = big("all_words") - most * big("source_size_before"), big("all_weights") - big("weight_before")
    stops = each.withColumn("stops", most * big("source_size") * weight_left <= words_left * big("weight"))
    free = stops.where(~F.col("stops")).agg(F.min("source_size_before").alias("stopped_words"), F.min("weight_before").alias("stopped_weight"))
    level = stops.crossJoin(F.broadcast(free))  # one row
    share = (F.col("all_words") - most * F.col("stopped_words")).cast("double") * F.col("weight") / (F.col("all_weights") - F.col("stopped_weight"))
    return level.withColumn("target", F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(share)).select(*sources.columns, "weight", "target")


def mix(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 2048, least_blocks: int = 512, shard_blocks: int = 1024, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """A mixture of the sources as two frames.

    * documents: row (a number), doc_id, size (words), source_size, target, source, no_source; one for each row of `df`
    * spans: shard, slot, source, no_source, block, row, first, words: `words` words of a document from its word `first` on, in each place of
      the mixture; a shard's slots are numbered from 0 and its spans ordered by slot and row

    A source's documents, in the order of doc_id, are one line of words, cut in blocks of b = min(`block`, words / `least_blocks`) words, at least one;
    the last is shorter. The mixture has quota = target * blocks / words places (rounded, at most `most` * blocks) for each source, in
    shards of `shard_blocks` places. Every place of a shard draws its source by chance in proportion to the quotas: a multinomial draw for
    each shard. Where all shards together drew a source more often than its quota, its last places go to sources drawn less often, so totals are the quotas.
    A source's k-th place takes block p(k mod blocks), where p is a pseudorandom permutation of the source's blocks, another one for each time round: no
    block is used twice more than any other, and none over `most` times.

    Chance is MD5 of the seed and numbers, so reruns and other partitionings agree. Draws, quotas and blocks are joined by number; nothing is collected, and only tables of
    one row and sums of partitions are broadcast. Rows that one source makes are written out by runs of RUN rows in tasks of their own.

    Null text: no words. A null source is a source, the last one. Rows without words get nothing; they and ties of doc_id are ordered by size. Repeated rows are
    rows of their own. Null ids come first. Other columns are ignored, whatever their names. A very long text is one row until its words' places are
    written, one row for each block it touches. An empty table, or one without words, gives empty spans.
    """
    ws = Workspace(df.sparkSession, "mix")
    slim = ws.save(sized(df, id_col, text_col, source_col).withColumn("tie", F.monotonically_increasing_id()))
    line = ws.save(running_sums(slim, [*KEY, "doc_id", "size", "tie"], ["size"]).drop("tie"))
    totals = line.groupBy(*KEY).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.min("size_before").alias("start"))
    targets = with_targets(ws.save(totals), weights, most)
    length = F.greatest(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.floor(F.col("source_size") / least_blocks)))
    blocks = F.floor((F.col("source_size") + F.col("b") - 1) / F.col("b"))
    quota = F.when(F.col("source_size") > 0, F.least(most * F.col("blocks"), F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5))).otherwise(0)
    sources = ws.save(targets.withColumn("b", length).withColumn("blocks", blocks).withColumn("quota", quota.cast("long")))
    documents = ws.save(with_summary(line, sources, KEY, "rows", line.count()).withColumn("first_word", F.col("size_before") - F.col("start")))

    # The places of all quotas in a row, and one draw among them for each place of the mixture.
    placed = ws.save(running_sums(sources.select(*KEY, "quota", "blocks"), KEY, ["quota"]).drop("position"))
    n = placed.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]
    lots = counted_out(placed, "quota", "k").select(*KEY, (F.col("quota_before") + F.col("k")).alias("lot"))
    drawn = df.sparkSession.range(n).select(F.col("id").alias("place"), (hashed(seed, "draw", F.col("id")) % max(n, 1)).alias("lot")).join(lots, "lot").select("place", *KEY)
    ordered = ws.save(running_sums(drawn, [*KEY, "place"]))
    counts = ordered.groupBy(*KEY).agg(F.count("*").alias("drawn"), F.min("position").alias("first_position"))
    balance = placed.join(counts, KEY, "left").withColumns({"drawn": F.coalesce("drawn", F.lit(0)), "first_position": F.coalesce("first_position", F.lit(0))})
    balance = balance.withColumns({"over": F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), "under": F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))})
    balance = ws.save(running_sums(balance.drop("quota_before"), KEY, ["over", "under"]).drop("position"))
    numbered = ws.save(with_summary(ordered, balance, KEY, "drawn", n).withColumn("k", F.col("position") - F.col("first_position")))
    spare = numbered.where("k >= quota").select("place", (F.col("over_before") + F.col("k") - F.col("quota")).alias("number"))
    missing = counted_out(balance, "under", "m").select(*KEY, "blocks", (F.col("drawn") + F.col("m")).alias("k"), (F.col("under_before") + F.col("m")).alias("number"))
    places = numbered.where("k < quota").select("place", *KEY, "blocks", "k").unionByName(spare.join(missing, "number").select("place", *KEY, "blocks", "k"))

    # Each place's block, and the documents' words in it.
    turn = F.floor(F.col("k") / F.col("blocks"))
    which = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), seed, F.col("no_source"), F.col("source"), turn)
    taken = places.select(F.floor(F.col("place") / shard_blocks).alias("shard"), (F.col("place") % shard_blocks).alias("slot"), *KEY, which.alias("block"))
    last = F.floor((F.col("first_word") + F.col("size") - 1) / F.col("b"))
    pieces = documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first_word") / F.col("b")), last)))
    low = F.greatest(F.col("first_word"), F.col("block") * F.col("b"))
    high = F.least(F.col("first_word") + F.col("size"), (F.col("block") + 1) * F.col("b"))
    pieces = pieces.select(*KEY, "block", F.col("position").alias("row"), (low - F.col("first_word")).alias("first"), (high - low).alias("words"))
    spans = taken.join(pieces, [*KEY, "block"]).select("shard", "slot", *KEY, "block", "row", "first", "words")
    return documents.select(F.col("position").alias("row"), "doc_id", "size", "source_size", "target", *KEY), spans


def mixture_counts(df: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words the mixture takes from each row, repeats counted. See `mix`."""
    documents, spans = mix(df, **options)
    taken = spans.groupBy("row").agg(F.sum("words").alias("taken"))
    return documents.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
