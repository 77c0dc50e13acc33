"""An index on disk: dictionary, sequences, paths, edges and successor runs, with the parameters they belong to.

A stored index is a folder of Parquet tables and a manifest, which is written
last; so a folder without a manifest is one whose writing did not end.  Nodes are
dealt out by their fragment and paths by their id, each in order inside its
files, so that look-ups and scans by key read few of them.  The manifest also
says which programs made the index and from what; an index made from another
goes on with that one's list.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators import dictionary, graph, pathindex, pathing, selection
from strandweave.params import SampleParams
from strandweave.runtime import Workspace, running_total

FORMAT = "strandweave-index-1"
TABLES = ("nodes", "sequences", "visits", "ends", "edges", "runs", "starts")


@dataclass
class Index:
    """Tables by name, all made of the same sequences with the same parameters.

    nodes (node, canon, count, max_count, first_seq, first_pos, first_orient, loc);
    sequences (path_id, file, len, start); visits (path_id, idx, node, pos);
    ends (path_id, prefix, suffix); edges (node, adj, off, count);
    runs (node, run_no, next_node, next_gap, run_len);
    starts (path_id, strand, node, number).
    """

    params: SampleParams
    tables: dict[str, DataFrame]
    provenance: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def build(ws: Workspace, seqs: DataFrame, p: SampleParams, known: Index | None = None, ends: bool = True, index: bool = True, only: tuple[str, ...] | None = None) -> Index:
    """An index of seqs (seq_ord, file, seq); with ``known`` its dictionary goes on, ids and counts included.

    ``ends`` can be left out where sequences need not be rebuilt, ``index`` where
    only the dictionary and the paths are wanted.  ``only`` names the tables that
    are wanted; others are made as far as these need them.
    """
    if known is not None:
        known.params.require(p)
    wanted = [t for t in TABLES if (ends or t != "ends") and (index or t not in ("edges", "runs", "starts")) and (only is None or t in only)]
    files = ws.put(running_total(ws, seqs.select("seq_ord", "file", F.length("seq").cast("long").alias("len")), ["seq_ord"], F.col("len"), "start"), "sequences")
    tables = {"sequences": files.withColumnRenamed("seq_ord", "path_id")}
    if set(wanted) - {"sequences"}:
        occurrences = ws.put(selection.syncmers(seqs.select("seq_ord", "seq"), p), "occurrences")
        nodes = dictionary.build(ws, occurrences, files) if known is None else dictionary.extend(ws, known.nodes, occurrences, files).drop("is_new")
        tables["nodes"] = ws.put(nodes, "nodes")
    if set(wanted) - {"sequences", "nodes"}:
        visits = tables["visits"] = ws.put(pathing.visits(dictionary.look_up(occurrences, tables["nodes"])), "visits")
        if "ends" in wanted:
            tables["ends"] = pathing.ends(seqs, visits, p)
        ws.drop(occurrences)
        tables |= path_tables(ws, visits, wanted)
    return Index(p, {t: tables[t] for t in wanted}, list(known.provenance) if known else [], list(known.references) if known else [])


def path_tables(ws: Workspace, visits: DataFrame, wanted=TABLES) -> dict[str, DataFrame]:
    """edges, runs and starts of paths, those that are wanted: what a path index adds to them."""
    out = {}
    if "edges" in wanted:
        out["edges"] = ws.put(graph.edges(visits), "edges")
    if "runs" in wanted:
        ordered = ws.put(pathindex.visit_order(ws, visits), "ordered")
        out["runs"] = ws.put(pathindex.runs(pathindex.successors(ordered)), "runs")
    if "starts" in wanted:
        out["starts"] = graph.start_numbers(visits)
    return out


#: Each table's keys: what its rows are dealt out and sorted by.
_KEYS = {"nodes": ("canon",), "sequences": ("path_id",), "visits": ("path_id", "idx"), "ends": ("path_id",), "edges": ("node", "off", "adj"), "runs": ("node", "run_no"), "starts": ("path_id", "strand")}


def save_index(index: Index, path: str, program: str = "strandweave", command: str = "") -> None:
    """Write an index below path, which must not exist."""
    spark = next(iter(index.tables.values())).sparkSession
    for name, table in index.tables.items():
        table.repartitionByRange(*_KEYS[name]).sortWithinPartitions(*_KEYS[name]).write.parquet(f"{path}/{name}")
    made = {"program": program, "version": FORMAT, "command": command, "date": time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())}
    manifest = {"format": FORMAT, "params": asdict(index.params), "tables": list(index.tables), "provenance": [*index.provenance, made], "references": index.references}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """Parameters, names of tables, programs and references of a stored index."""
    manifest = json.loads(spark.read.parquet(f"{path}/manifest").first().manifest)
    if manifest["format"] != FORMAT:
        raise ValueError(f"{path} has format {manifest['format']}")
    return manifest


def load_index(spark: SparkSession, path: str, params: SampleParams | None = None) -> Index:
    """A stored index; raises if it was made with other parameters than asked for."""
    manifest = read_manifest(spark, path)
    have = SampleParams(**manifest["params"])
    if params is not None:
        have.require(params)
    return Index(have, {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}, manifest["provenance"], manifest["references"] + [{"path": path}])


def check_index(index: Index) -> DataFrame:
    """(what, key): violations of what holds in every index; none if it is sound.

    Ends fit paths and lengths; steps are dense and ascend; every visited node is
    known; an edge has the count of its mirror image; a node's runs are maximal,
    numbered from 0, and as long as its visits and its edges' counts together.
    """
    p = index.params
    found = []

    def add(what: str, rows: DataFrame, key) -> None:
        found.append(rows.select(F.lit(what).alias("what"), F.col(key).cast("string").alias("key")))

    span = index.visits.groupBy("path_id").agg(F.count("*").alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count_distinct("pos").alias("places"))
    add("steps are not dense", span.where("low <> 0 OR high <> n - 1 OR places <> n"), "path_id")
    add("unknown node", index.visits.select(F.abs("node").alias("node")).distinct().join(index.nodes.select("node"), "node", "left_anti"), "node")
    add("path without a sequence", span.join(index.sequences, "path_id", "left_anti"), "path_id")
    if "ends" in index.tables:
        seqs = index.sequences.select(F.col("path_id").alias("seq_ord"), "len")
        add("ends do not fit", pathing.check_paths(seqs, index.visits, index.ends, p).where("NOT ok"), "path_id")
    if "edges" in index.tables:
        inner = index.edges.where("adj <> 0")
        mirror = inner.select((-F.col("adj")).alias("node"), (-F.col("node")).alias("adj"), "off", F.col("count").alias("back"))
        both = inner.join(mirror, ["node", "adj", "off"], "full")
        add("edge without its mirror", both.where("count IS NULL OR back IS NULL OR count <> back"), "node")
    if "runs" in index.tables:
        add("runs", check_runs(index.runs), "node")
        came = index.edges.groupBy("node").agg(F.sum("count").alias("came"))
        lasting = index.runs.groupBy("node").agg(F.sum("run_len").alias("left"))
        add("as many visits as arrivals", came.join(lasting, "node", "full").where("came IS NULL OR left IS NULL OR came <> left"), "node")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def check_runs(runs: DataFrame) -> DataFrame:
    """(node): lists whose runs are empty, not numbered from 0, or equal to the run before."""
    from pyspark.sql import Window as Over

    order = Over.partitionBy("node").orderBy("run_no")
    same = (F.lag("next_node").over(order) == F.col("next_node")) & (F.lag("next_gap").over(order) == F.col("next_gap"))
    rows = runs.withColumn("_same", F.coalesce(same, F.lit(False))).withColumn("_no", F.row_number().over(order) - 1)
    return rows.where("_same OR run_len < 1 OR run_no <> _no").select("node").distinct()


def sequences_of(index: Index) -> DataFrame:
    """(path_id, seq): the sequences that an index was made of."""
    return pathing.rebuild(index.visits, index.nodes, index.ends, index.params)
