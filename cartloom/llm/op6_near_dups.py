"""Near-duplicate documents by HyperMinHash.

Each document's set of word shingles is sketched by 128 registers of leading-zero counts and mantissa bits; bands of registers are bucket
keys, and in each bucket the collision-corrected similarity estimate joins documents to candidate clusters. Within clusters the full
sets decide: blocks of sets are compared with each other, exactly, and the links' connected components are the classes.

Documents with equal sets are one from the start, so thousands of copies cost one. Buckets and clusters are compared block by block, a
block holding a bounded number of members, so a large group spreads over tasks; members that are joined already aren't compared any more,
so near copies by the thousand cost a comparison each, and what comes back is one row a member, not its pairs.

Defined cases: a null or wordless text has an empty set and links with nothing; a text of fewer words than a shingle is one shingle; ids
that are null never name a class unless all its ids are null; rows with the same id are documents of their own that share it; an empty
table gives no rows; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm import sketches
from cartloom.llm.buffers import slices
from cartloom.llm.common import lookup_join, own_columns, parts_for, read, written
from cartloom.llm.components import components

SHINGLE = 5
PERCENT = 80
#: Members of a block, for comparing sketches and full sets.
SKETCH_BLOCK = 1024
SET_BLOCK = 128
#: Standard errors by which an estimate may fall short of the similarity.
MARGIN = 4.5


#: ``similar(i, others)`` of a block: which of the others member i is similar to.
Similar = Callable[[int, np.ndarray], np.ndarray]


def _grouped(n: int, similar: Similar, group: np.ndarray, first: int = 0) -> np.ndarray:
    """Groups of ``n`` members after joining all that are similar. Pairs within a group are never compared, since their link would change nothing,
    so a block of near copies costs one comparison a member. ``first`` (0: none) is the size of the first of two blocks, whose members
    are compared with the other's only."""
    group = group.copy()
    for i in range(first or n):
        others = np.flatnonzero(group != group[i])
        others = others[np.searchsorted(others, first or i + 1) :]
        if len(others):
            found = others[similar(i, others)]
            if len(found):
                group[np.isin(group, group[found])] = group[i]
        elif not first and (group == group[0]).all():
            break
    return group


def _edges(nodes: list[bytes], before: np.ndarray, after: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Links that join the members of each group which weren't together before."""
    _, lead, which = np.unique(after, return_index=True, return_inverse=True)
    apart = np.flatnonzero(before != before[lead[which]])
    return [(nodes[i], nodes[k]) for i, k in zip(apart.tolist(), lead[which[apart]].tolist(), strict=True)]


def _compared(blocks: DataFrame, similarity: Callable[[list], Similar], crossed: bool) -> DataFrame:
    """Edges ``a``, ``b`` from rows of two member lists; ``crossed``: between the lists, else within them, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: set[tuple[bytes, bytes]] = set()
            for r in range(batch.num_rows):
                one, two = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                members = one + two
                nodes = [m["node"] for m in members]
                # the same text's set may come twice, and members that are linked already share a label
                _, before = np.unique(np.array([m["label"] for m in members], dtype=object), return_inverse=True)
                edges.update(_edges(nodes, before, _grouped(len(members), similarity(members), before, len(one) if crossed else 0)))
            found = list(edges)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return blocks.select("one", "two").mapInArrow(run, "a binary, b binary")


def _linked(members: DataFrame, group: str, size: str, lead: str, block: int, payload: list[str], similarity: Callable[[list], Similar]) -> DataFrame:
    """Connected components (``node``, ``root``) of the links between members of the same group; ``lead`` is a node of the group, the same for all.

    Members are dealt into blocks. First each block is compared within itself and with the group's lead, which settles a group of near copies;
    where a group of several blocks still falls apart, every two of its blocks meet once, and only members of different components are compared.
    """
    count = F.ceil(F.col(size) / block).cast("int")
    dealt = members.select(F.col(group).alias("g"), count.alias("blocks"), F.pmod(F.hash("node"), count).alias("i"), "node", *payload, F.col(lead).alias("lead"))
    dealt = written(dealt, "dealt")
    spark, rows = dealt.sparkSession, dealt.count()
    parts = parts_for(spark, rows)

    def packed(rows: DataFrame, label: str) -> DataFrame:
        return rows.groupBy("g", "blocks", "i").agg(F.collect_list(F.struct("node", F.col(label).alias("label"), *payload)).alias("two"))

    leads = dealt.filter("node = lead AND blocks > 1").groupBy(F.col("g").alias("h")).agg(F.slice(F.collect_list(F.struct("node", F.col("node").alias("label"), *payload)), 1, 1).alias("one"))
    blocks = packed(dealt, "node")
    nobody = F.expr("slice(two, 1, 0)")
    alone = blocks.filter("blocks = 1").filter(F.size("two") > 1).select(nobody.alias("one"), "two")
    several = blocks.filter("blocks > 1").join(leads, F.col("g") == F.col("h")).select("one", "two")
    # a task compares a few blocks
    near = written(components(_compared(alone.unionByName(several).coalesce(parts_for(spark, rows, 2 * block)), similarity, False)), "joined", parts)

    large = dealt.filter("blocks > 1").join(near.withColumnRenamed("node", "joined"), F.col("node") == F.col("joined"), "left").withColumn("root", F.coalesce("root", "node"))
    large = written(large.drop("joined", "lead"), "large", parts)
    apart = large.groupBy(F.col("g").alias("h")).agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("h")
    if apart.isEmpty():
        return near
    blocks = packed(large.join(apart, F.col("g") == F.col("h"), "left_semi"), "root")
    left = blocks.filter("i < blocks - 1").withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("blocks") - 1))).withColumnRenamed("two", "one")
    right = blocks.filter("i > 0").select(F.col("g").alias("h"), F.col("i").alias("k"), "two")
    met = left.join(right, (F.col("g") == F.col("h")) & (F.col("j") == F.col("k")))
    links = _compared(met, similarity, True).unionByName(near.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components(links)


def _similar_sketches(share: float) -> Callable[[list], Similar]:
    least = share - MARGIN * float(np.sqrt(share * (1 - share) / sketches.BUCKETS))

    def similarity(members: list) -> Similar:
        table = np.frombuffer(b"".join(m["registers"] for m in members), dtype=np.uint16).reshape(len(members), -1)
        size = np.array([m["n"] for m in members])
        distinct, which = np.unique(size, return_inverse=True)
        levels = sketches.level_shares(distinct)

        def similar(i: int, others: np.ndarray) -> np.ndarray:
            # sets whose sizes differ too much can't be similar
            near = np.minimum(size[i], size[others]) >= share * np.maximum(size[i], size[others]) - 1e-9
            out = np.zeros(len(others), dtype=bool)
            mine = others[near]
            by_chance = sketches.chance(levels, which[i])[which[mine]]
            out[near] = sketches.corrected((table[i] == table[mine]).mean(axis=1), by_chance) >= least
            return out

        return similar

    return similarity


def _similar_sets(percent: int) -> Callable[[list], Similar]:
    def similarity(members: list) -> Similar:
        sets = [np.frombuffer(m["members"], dtype=np.uint64) for m in members]
        size = np.array([len(s) for s in sets])
        distinct, column = np.unique(np.concatenate(sets), return_inverse=True)
        held = np.zeros(len(distinct), dtype=bool)
        begin = np.append(0, np.cumsum(size))

        def similar(i: int, others: np.ndarray) -> np.ndarray:
            mine = column[begin[i] : begin[i + 1]]
            held[mine] = True
            common = np.add.reduceat(held[column], begin[:-1], dtype=np.int64)[others]
            held[mine] = False
            return 100 * common >= percent * (size[i] + size[others] - common)

        return similar

    return similarity


def _sketched(docs: DataFrame, text: str, width: int) -> DataFrame:
    """All columns but the text, ``node`` (digest of the set), ``n`` and ``registers`` (null for empty sets)."""
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(len(kept))):
                sets = sketches.shingle_sets(part, width)
                full = [s for s in sets if len(s)]
                tables = iter(sketches.registers(full))
                rows = batch.slice(part.first, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns[: len(kept)],
                        pa.array(sketches.set_digests(sets), pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([next(tables).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    [*kept, "node", "n", "registers"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept, F.col(text).cast("binary")).mapInArrow(run, f"{fields}, node binary, n long, registers binary")


def _bands(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                rows = batch.slice(first, 2000)
                keys = sketches.band_keys(np.frombuffer(b"".join(rows.column(1).to_pylist()), dtype=np.uint16).reshape(rows.num_rows, -1))
                owner = np.repeat(np.arange(keys.shape[0]), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), rows.column(0).take(pa.array(owner))], ["band", "node"])

    return sets.select("node", "registers").mapInArrow(run, "band long, node binary")


def classes(docs: DataFrame, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketch table (all columns but the text, ``text_digest``, ``node``, ``n``) and ``node``, ``root`` of the nodes that are linked."""
    keyed = docs.withColumn("text_digest", F.unhex(F.md5(F.col(text).cast("binary"))))
    table = written(_sketched(keyed, text, width), "sketches")
    sets = table.filter("n > 0").groupBy("node").agg(F.first("registers").alias("registers"), F.first("n").alias("n"), F.min("text_digest").alias("text_digest"))
    sets = written(sets, "sets")
    bands = written(_bands(sets), "bands")
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lead")).filter("size > 1")
    met = lookup_join(bands, shared, ["band"], "size")
    met = met.join(sets.select("node", "n", "registers").hint("merge"), "node")
    clusters = written(_linked(met, "band", "size", "lead", SKETCH_BLOCK, ["n", "registers"], _similar_sketches(percent / 100)), "clusters")
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = written(lookup_join(clusters, sizes, ["root"], "size").join(sets.select("node", "text_digest"), "node"), "members")
    wanted = members.select("text_digest", "node").join(table.select("node", "text_digest").groupBy("text_digest").agg(F.count(F.lit(1)).alias("copies")), "text_digest")
    texts = lookup_join(keyed.select("text_digest", F.col(text).cast("binary").alias("text")), wanted, ["text_digest"], "copies")
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                found = sketches.shingle_sets(part, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(found)), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "members"])

    full = texts.mapInArrow(collect, "node binary, members binary").join(members.select("node", "root", "size"), "node")
    # the cluster's name is one of its nodes
    return table, _linked(full.withColumn("lead", F.col("root")), "root", "size", "lead", SET_BLOCK, ["members"], _similar_sets(percent))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``id``, ``text_digest``, ``n_shingles``, ``root`` (names the class), ``component_id`` and ``kept``."""
    table, linked = classes(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "text", width, percent)
    linked = written(linked, "linked")
    by_node = table.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows_"))
    rooted = by_node.join(linked, "node", "left").select("node", "least", "rows_", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    # a class's least id; classes are looked up by root, then documents by set
    named = lookup_join(rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes_")), ["root"], "nodes_")
    out = lookup_join(table.select("id", "text_digest", "node", "n"), named.select("node", "root", "component_id", "rows_"), ["node"], "rows_", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "text_digest", F.col("n").alias("n_shingles"), "root", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id. Documents without words stay."""
    # rows get a number in a written table, so that a row is one row whatever its columns hold
    (number,) = own_columns(docs, "row_number_")
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col(number))
    judged = near_duplicates(numbered.select(order.alias("o"), "text"), "o")
    best = judged.filter("kept").select(F.col(f"id.{number}").alias("best_"))
    return numbered.join(best.hint("merge"), F.col(number) == F.col("best_"), "left_semi").select(*docs.columns)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


QUERIES = {"op6_near_duplicates": op6_near_duplicates}
ORACLE: dict[str, str] = {}
