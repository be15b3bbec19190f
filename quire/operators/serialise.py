"""Documents rewritten by relations: objects and streams are rows from reading to the last byte.

``rewritten_parts`` takes the tables of ``scan_together`` and lays every document down
anew as parts in order, each an object, a run of the cross-reference table, or the
trailer. Objects are kept if the trailer leads to them; equal ones are merged by
partition refinement; streams without a filter are compressed, each as a row of its
own, over all tasks; byte offsets are prefix sums (``segmented_scan``) of the parts'
sizes. So no task writes more than its rows, however large a document is.
``write_parts`` puts the parts into files, ``assembled`` joins those of a document in one
cell, for documents that fit into one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quire.functions.filters import flate_encode
from quire.operators import relations as R
from quire.operators.graphs import aliases_of, refined
from quire.operators.scans import segmented_scan
from quire.plans.session import cut_lineage, parts_for
from quire.sources.pdf.objects import Name, Ref, Stream, from_json, write_value
from quire.sources.pdf.write import IDENTITY_KEYS, with_references

#: Numbers whose cross-references are one part.
RUN = 4096
#: Bytes of objects in file syntax after which a batch is cut.
MADE_BYTES = 1 << 20
#: Bytes of texts or objects that one task is given: tasks of the stages that only read them are short.
TASK_BYTES = 8 << 20
#: Most objects that one task writes.
OBJECTS = 20_000
#: Types whose equal objects may stand for each other. Streams may unless they have an identity.
MERGED_TYPES = ("Font", "FontDescriptor", "ExtGState", "Encoding", "XObject", "Pattern")
REFERENCE = r'\{"\$r":\[\d+,\d+\]\}'
TABLES = ["documents", "objects", "streams", "object_refs"]
#: What is read of ``TABLES``; above all, streams are not kept undone as well.
COLUMNS = {"documents": ["version", "trailer_json"], "objects": ["num", "kind", "value_json"], "streams": ["num", "dict_json", "raw"], "object_refs": ["src_num", "path", "dst_num"]}


@dataclass
class Progress:
    """What the stages of rewriting report when they have run: each is an observation of the rows that it wrote."""

    stages: dict[str, Observation] = field(default_factory=dict)

    def watch(self, df: DataFrame, stage: str, **sums: Column) -> DataFrame:
        self.stages[stage] = Observation(stage)
        return df.observe(self.stages[stage], F.count("*").alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in sums.items()])

    def report(self) -> dict[str, dict[str, int]]:
        """Counters of every stage; waits for those that have not run."""
        return {stage: dict(o.get) for stage, o in self.stages.items()}


def kept_objects(held: dict[str, DataFrame]) -> DataFrame:
    """doc_id, num, value_json, raw, is_stream of the objects that the trailer leads to.

    A stream's value is its dictionary. The encryption dictionary is left out, since
    values are read decrypted.
    """
    edges = held["object_refs"].where("NOT (src_num = 0 AND path LIKE '/Encrypt%')").select("doc_id", F.col("src_num").alias("src"), F.col("dst_num").alias("dst"))
    met = R.reachable(edges, held["documents"].select("doc_id", F.lit(0).cast("long").alias("num"))).where("num > 0").select("doc_id", "num")
    streams = held["streams"].select("doc_id", "num", "dict_json", "raw")
    plain = held["objects"].where("kind <> 'stream'").select("doc_id", "num", F.col("value_json"), F.lit(None).cast("binary").alias("raw"), F.lit(False).alias("is_stream"))
    return plain.union(streams.select("doc_id", "num", "dict_json", "raw", F.lit(True))).join(met, ["doc_id", "num"], "left_semi")


def merged_objects(objects: DataFrame, references: DataFrame) -> DataFrame:
    """doc_id, num, canonical_num: objects that an equal one of their document stands for.

    Objects are equal when their values are, references apart, and what they refer to
    is equal, all the way down and around. Streams with an identity, and objects of
    other types than ``MERGED_TYPES``, are like no other.
    """
    own = F.get_json_object("value_json", "$.Type.$n")
    identity = F.lit(False)
    for key in IDENTITY_KEYS:
        identity = identity | F.get_json_object("value_json", f"$.{key}").isNotNull()
    free = F.when(F.col("is_stream"), ~identity).otherwise(own.isin(*MERGED_TYPES) & ~identity)
    shape = F.concat_ws(" ", F.regexp_replace("value_json", REFERENCE, "R"), F.sha2("raw", 256))
    _, shared = refined(objects.select("doc_id", "num", shape.alias("shape"), (~F.coalesce(free, F.lit(False))).alias("fixed")), references, across=False)
    return aliases_of(shared)


def _body(num: int, value: str, raw: bytes | None, alias: dict[int, int], packed: bool) -> tuple[bytes, bool]:
    """An object as it stands in a file, and whether it has been compressed."""
    own = with_references(from_json(value), lambda r: Ref(alias.get(r.num, r.num), 0))
    done = False
    if raw is not None:
        if packed and "Filter" not in own and "F" not in own and len(data := flate_encode(raw)) < len(raw):
            own, raw, done = own | {"Filter": Name("FlateDecode")}, data, True
        own = Stream(own, raw)
    return b"%d 0 obj\n%b\nendobj\n" % (num, write_value(own)), done


def coded(objects: DataFrame, aliases: DataFrame, references: DataFrame, compress: bool = True) -> DataFrame:
    """doc_id, num, data, size, compressed: every object in file syntax, each by the task that holds its row.

    References to merged objects are changed; an object brings only the aliases of
    what it refers to.
    """
    targets = aliases.select(F.col("doc_id").alias("_doc"), F.col("num").alias("_dst"), "canonical_num")
    changed = references.join(targets, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("dst_num") == F.col("_dst"))).groupBy(F.col("doc_id").alias("_doc"), F.col("src_num").alias("_num"))
    changed = changed.agg(F.collect_set(F.struct(F.col("dst_num").alias("a"), F.col("canonical_num").alias("b"))).alias("alias"))
    on = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("num") == F.col("_num"))
    left = objects.join(targets.withColumnRenamed("_dst", "_num"), on, "left_anti").join(changed, on, "left").select("doc_id", "num", "value_json", "raw", "alias")
    # small objects are as much work as large ones, so partitions are not dealt by bytes alone
    left = left.repartition(parts_for(objects, rows=OBJECTS, size=TASK_BYTES))
    id_type = objects.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nums, values, known = (batch.column(c).to_pylist() for c in (1, 2, 4))
            made, size, first = [], 0, 0
            for i, num in enumerate(nums):
                made.append(_body(num, values[i], batch.column(3)[i].as_py(), {x["a"]: x["b"] for x in known[i] or ()}, compress))
                size += len(made[-1][0])
                if size >= MADE_BYTES or i == len(nums) - 1:
                    data, done = zip(*made, strict=True)
                    own = [batch.column(0).slice(first, len(made)), pa.array(nums[first : i + 1], pa.int64()), pa.array(data, pa.binary()), pa.array([*map(len, data)], pa.int64()), pa.array(done, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(own, names=["doc_id", "num", "data", "size", "compressed"])
                    made, size, first = [], 0, i + 1

    return left.mapInArrow(run, f"doc_id {id_type}, num long, data binary, size long, compressed boolean")


def laid_down(bodies: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, ord, offset, data: the parts of every file in order.

    ``bodies``: as of ``coded``. ``documents``: doc_id, version, trailer_json. Parts are
    numbered by object number; the table of cross-references follows in runs of
    ``RUN`` numbers, free numbers included, then the trailer.
    """
    header = F.concat(F.lit("%PDF-").cast("binary"), F.coalesce("version", F.lit("1.7")).cast("binary"), F.lit(b"\n%\xe2\xe3\xcf\xd3\n"))
    sized = bodies.select("doc_id", "num", "size").union(documents.select("doc_id", F.lit(0), F.octet_length(header).cast("long")))
    total = lambda a, b: a + b
    placed = cut_lineage(segmented_scan(sized, ["doc_id"], "num", F.col("size"), total, "stop").select(F.col("doc_id").alias("_doc"), F.col("num").alias("_num"), (F.col("stop") - F.col("size")).alias("offset"), "stop"))
    ends = placed.groupBy("_doc").agg(F.max("_num").alias("last"), F.max("stop").alias("at"))
    known = documents.join(ends, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "version", "trailer_json", "last", "at")

    # cross-references: every number of a run has a row of 20 bytes, free unless it is placed
    runs = known.select("doc_id", "last", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / RUN))).alias("run"))
    entries = placed.where("_num > 0").groupBy("_doc", F.floor(F.col("_num") / RUN).alias("_run")).agg(F.map_from_entries(F.collect_list(F.struct("_num", "offset"))).alias("held"))
    free, used = "0000000000 65535 f \n", lambda at: F.concat(F.lpad(at.cast("string"), 10, "0"), F.lit(" 00000 n \n"))
    numbers = F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN - 1, F.col("last")))
    rows = F.array_join(F.transform(numbers, lambda n: F.coalesce(used(F.try_element_at("held", n)), F.lit(free))), "")
    head = F.concat(F.lit("xref\n0 "), (F.col("last") + 1).cast("string"), F.lit("\n"))
    at_run = F.when(F.col("run") == 0, F.col("at")).otherwise(F.col("at") + F.length(head) + F.col("run") * RUN * len(free))
    table = runs.join(entries, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("run") == F.col("_run")), "left").select(
        "doc_id", (F.col("last") + 1 + F.col("run")).alias("ord"), at_run.alias("offset"), F.when(F.col("run") == 0, F.concat(head, rows)).otherwise(rows).cast("binary").alias("data")
    )
    closing = F.concat(F.pandas_udf(_trailers, "binary")("trailer_json", F.col("last") + 1), F.concat(F.lit("startxref\n"), F.col("at").cast("string"), F.lit("\n%%EOF\n")).cast("binary"))
    after = F.col("at") + F.length(head) + (F.col("last") + 1) * len(free)
    trailer = known.select("doc_id", (F.col("last") + 2 + F.floor(F.col("last") / RUN)).alias("ord"), after.alias("offset"), closing.alias("data"))
    objects = bodies.join(placed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("num") == F.col("_num"))).select("doc_id", F.col("num").alias("ord"), "offset", "data")
    first = known.select("doc_id", F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("offset"), header.alias("data"))
    return first.union(objects).union(table).union(trailer)


def _trailers(trailers, sizes):
    """The trailers' own entries that a rewritten file keeps, in file syntax."""
    import pandas as pd

    kept = lambda text, size: {k: v for k, v in from_json(text).items() if k in ("Root", "Info", "ID")} | {"Size": int(size)}
    return pd.Series([b"trailer\n" + write_value(with_references(kept(t, n), lambda r: Ref(r.num, 0))) + b"\n" for t, n in zip(trailers, sizes, strict=True)])


def rewritten_parts(held: dict[str, DataFrame], optimise: bool = True, progress: Progress | None = None) -> DataFrame:
    """doc_id, ord, offset, data of every document of ``held`` (``TABLES`` of ``scan_together``), written anew.

    Objects keep their numbers. Signed documents are laid down without a change of
    theirs only if they are left out of ``held``. A document without a catalogue has
    no parts.
    """
    watch = (progress or Progress()).watch
    # what is read round after round is kept beside the streams, not among them
    held = held | {t: cut_lineage(held[t]) for t in ("documents", "object_refs")}
    documents = held["documents"].where(F.get_json_object("trailer_json", "$.Root").isNotNull())
    objects = cut_lineage(watch(kept_objects(held), "scan", bytes=F.octet_length("raw")))
    references = held["object_refs"]
    none = objects.select("doc_id", "num", F.col("num").alias("canonical_num")).where("false")
    aliases = cut_lineage(watch(merged_objects(objects, references.join(objects.select(F.col("doc_id"), F.col("num").alias("src_num")), ["doc_id", "src_num"], "left_semi")) if optimise else none, "merge"))
    bodies = cut_lineage(watch(coded(objects, aliases, references, optimise), "compress", bytes=F.col("size"), compressed=F.col("compressed").cast("long")))
    return watch(laid_down(bodies, documents), "write", bytes=F.octet_length("data"))


def assembled(parts: DataFrame) -> DataFrame:
    """doc_id, content: the parts of a document in one cell, which holds at most 2 GB."""
    joined = F.pandas_udf(_joined, "binary")
    whole = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "data"))).alias("p"))
    return whole.select("doc_id", joined("p.data").alias("content"))


def _joined(parts):
    return parts.map(b"".join)


def write_parts(parts: DataFrame, folder: str, part_bytes: int = 64 << 20) -> DataFrame:
    """Writes every document as files ``folder/doc_id/offset`` in order of offset; returns doc_id, offset, path, size.

    Parts are sorted by document and place over all tasks; consecutive ones of a task
    go into one file up to ``part_bytes``, so a document's file names, sorted, are its
    bytes in order, whichever tasks wrote them. A task that runs again writes the same
    files. ``folder`` is on a file system that all executors reach.
    """
    id_type = parts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        doc, at, held, size = None, 0, [], 0

        def put() -> pa.RecordBatch:
            path = f"{root}/{doc}/{at:020d}"
            system.create_dir(f"{root}/{doc}", recursive=True)
            with system.open_output_stream(path) as out:
                out.write(b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([doc], field.type), pa.array([at], pa.int64()), pa.array([path]), pa.array([size], pa.int64())], names=["doc_id", "offset", "path", "size"])

        for batch in batches:
            field = batch.schema.field(0)
            for i in range(batch.num_rows):
                own, offset, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if held and (own != doc or size + len(data) > part_bytes):
                    yield put()
                    held, size = [], 0
                if not held:
                    doc, at = own, offset
                held.append(data)
                size += len(data)
        if held:
            yield put()

    ordered = parts.select("doc_id", "offset", "data").repartitionByRange("doc_id", "offset").sortWithinPartitions("doc_id", "offset")
    return cut_lineage(ordered.mapInArrow(run, f"doc_id {id_type}, offset long, path string, size long"))
