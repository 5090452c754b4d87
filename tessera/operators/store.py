"""A mutable store of facts, vectors and content on immutable Parquet snapshots.

A commit writes new files under a fresh name, then claims the next version's manifest, a small file that can be created only
once: of two writers on one version one gets an error.  Readers use the manifest they opened, so they see one snapshot whatever is
written meanwhile; a manifest holds a checksum, and one that is torn counts as never written.  A failed or aborted commit leaves
nothing behind but files that ``compact`` removes.

The commit gives every write its sequence number, whatever the rows bring along, so the last write wins.  Deletes are tables of keys
applied by anti joins at read time until compaction, which happens by itself once a store has ``compact_after`` files, so reading stays
bounded however many small commits there are.  Compacted facts are partitioned by topic and predicate and sorted by subject.  Paths
go through Hadoop's file system API, so the store lives on any file system Spark writes to.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import CONTENT, DEFAULT_TOPIC, FACT_KEY, FACTS, VECTORS, DimensionMismatch, Fact, InvalidFact, ReadOnly, StoreError, facts_df, valid_topic
from . import maintenance, scan

#: Tables as they are stored: ``order_`` tells rows of one write apart, ``seq_`` the writes of a vector.
TABLES = {"facts": T.StructType([*FACTS.fields, T.StructField("order_", T.LongType())]), "vectors": f"{VECTORS}, seq_ bigint", "content": CONTENT}
_MANIFEST = re.compile(r"manifest-(\d+)\.json")


class Store:
    """``Store(spark, path)`` opens or creates a store; ``facts()``, ``vectors()`` and ``content()`` read its current snapshot."""

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, read_only: bool | None = None, compact_after: int = 64):
        self.compact_after = compact_after
        self._torn: int | None = None
        self.spark, self.path = spark, path.rstrip("/")
        self.read_only = spark.conf.get("spark.tessera.readOnly", "false") == "true" if read_only is None else read_only
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.manifest = self._load()
        if self.manifest is None:
            self.manifest = {"version": 0, "format": 2, "seq": 0, "topic": DEFAULT_TOPIC, "dimension": dimension, "retention": 0, "log": []}
        if self.manifest["format"] != 2:
            raise StoreError(f"store format {self.manifest['format']}; this library reads 2")
        if dimension and self.manifest["dimension"] not in (None, dimension):
            raise DimensionMismatch(f"the store's vectors have {self.manifest['dimension']} dimensions")

    # -- files
    def _p(self, name: str):
        return self._fs_path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        root = self._p("")
        return [x.getPath().getName() for x in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def _read(self, name: str) -> bytes:
        stream = self._fs.open(self._p(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _load(self) -> dict | None:
        """The manifest of the latest version that was written as a whole."""
        self._torn = None
        for v in sorted((int(m[1]) for n in self._names() if (m := _MANIFEST.fullmatch(n))), reverse=True):
            check, _, body = self._read(f"manifest-{v}.json").partition(b"\n")
            if check == b"%08x" % zlib.crc32(body):
                return json.loads(body)
            self._torn = v
        return None

    def _save(self, manifest: dict) -> None:
        now = self._load()
        if (now or {"version": 0})["version"] != self.manifest["version"]:
            raise StoreError("the store changed since it was opened: refresh and try again")
        if self._torn == manifest["version"]:
            self._fs.delete(self._p(f"manifest-{self._torn}.json"), False)
        self._fs.mkdirs(self._p(""))
        tmp, to = self._p(f".manifest-{uuid4().hex}"), self._p(f"manifest-{manifest['version']}.json")
        body = json.dumps(manifest).encode()
        out = self._fs.create(tmp, True)
        out.write(bytearray(b"%08x\n" % zlib.crc32(body) + body))
        out.close()
        try:
            self._claim(tmp, to)
        except Exception as e:
            raise StoreError(f"version {manifest['version']} was written by another: refresh and try again") from e
        finally:
            self._fs.delete(tmp, False)
        self.manifest = manifest

    def _claim(self, tmp, to) -> None:
        """Give ``tmp`` the name ``to``, which must be free: atomically, and never over another file."""
        jvm = self.spark._jvm
        if self._fs.getUri().getScheme() == "file":  # a local rename would replace it
            jvm.java.nio.file.Files.createLink(jvm.java.io.File(to.toUri().getPath()).toPath(), jvm.java.io.File(tmp.toUri().getPath()).toPath())
            return
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(tmp, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def _sweep(self, *logs: list[dict]) -> None:
        """Remove all files but those of the logs and the last two manifests."""
        v = self.manifest["version"]
        used = {e["file"] for log in logs for e in log if "file" in e} | {f"manifest-{v}.json", f"manifest-{v - 1}.json"}
        for n in self._names():
            if n not in used:
                self._fs.delete(self._p(n), True)

    def refresh(self) -> Store:
        self.manifest = self._load() or self.manifest
        return self

    # -- reading
    def _table(self, name: str, log: list[dict]) -> DataFrame:
        """The log's appends and deletes in order; consecutive appends are one scan."""
        out = self.spark.createDataFrame([], TABLES[name])
        paths: list[str] = []
        last = [e for e in log if e["table"] == name][-1:]
        last = last[0] if last and name == "facts" else None

        def flush(df: DataFrame) -> DataFrame:
            return df.unionByName(self.spark.read.schema(df.schema).parquet(*paths)) if paths else df

        for e in log:
            if e["table"] != name:
                continue
            if e["op"] == "add" and not e.get("parts"):
                paths.append(f"{self.path}/{e['file']}")
                continue
            out, paths = flush(out), []
            if e["op"] == "add":  # partitioned: a scan of its own, which a bound topic or predicate prunes
                out = out.unionByName(self.spark.read.schema(out.schema).parquet(f"{self.path}/{e['file']}"))
            else:
                if e is last:  # dealt out by the keys of the delete, which serve what follows as well
                    out = out.repartition(*e["keys"])
                out = out.join(self.spark.read.parquet(f"{self.path}/{e['file']}"), e["keys"], "left_anti")
        return flush(out)

    def _facts(self, log) -> DataFrame:
        log = [e for e in log if e["table"] == "facts"]
        df = self._table("facts", log)
        if [e.get("set") for e in log if e["op"] == "add"] == [True]:  # compacted, nothing added since
            return df.select(*[f.name for f in FACTS.fields])
        # dealt out first: the aggregate has rows as its buffers and would sort before a shuffle, then again
        return self._last(df if log and log[-1]["op"] == "delete" else df.repartition(*FACT_KEY))

    @staticmethod
    def _last(df: DataFrame, key: list[str] | tuple[str, ...] = FACT_KEY) -> DataFrame:
        """Of equal facts the last written."""
        rest = [f.name for f in FACTS.fields if f.name not in FACT_KEY]
        last = F.max_by(F.struct(*rest), F.struct("ingest_seq", "order_"))
        return df.groupBy(*key).agg(last.alias("x")).select(*FACT_KEY, "x.*").select(*[f.name for f in FACTS.fields])

    def facts(self) -> DataFrame:
        """The facts, a set: of equal ones the last written."""
        return self._facts(self.manifest["log"])

    def vectors(self) -> DataFrame:
        return self._vectors(self.manifest["log"])

    def _vectors(self, log) -> DataFrame:
        df = self._table("vectors", log)
        rest = [c for c in df.columns if c not in ("entity_id", "seq_")]
        return df.groupBy("entity_id").agg(F.max_by(F.struct(*rest), "seq_").alias("x")).select("entity_id", "x.*")

    def content(self) -> DataFrame:
        return self._content(self.manifest["log"])

    def _content(self, log) -> DataFrame:
        last = F.max(F.struct("ingest_seq", "data"))  # equal rows of one write: the greatest
        return self._table("content", log).groupBy("entity_id").agg(last.alias("x")).select("entity_id", "x.data", "x.ingest_seq")

    def count(self) -> int:
        return self.facts().count()

    @property
    def topic(self) -> int:
        return self.manifest["topic"]

    # -- writing
    def transaction(self) -> Transaction:
        if self.read_only:
            raise ReadOnly("the store is read-only")
        return Transaction(self)

    def update(self, fn: Callable[[Transaction], Any]) -> Any:
        """All of what ``fn`` does to the transaction, or, if it raises, nothing."""
        with self.transaction() as tx:
            return fn(tx)

    def add_facts(self, facts: Iterable[Fact | tuple] | DataFrame, topic: int | None = None) -> int:
        """Insert or overwrite; returns how many were new (of a table that takes a join with the store: ``tx.add_frame`` can do without)."""
        return self.update(lambda tx: tx.add_facts(facts, topic))

    def add_if_absent(self, fact: Fact | tuple, topic: int | None = None) -> bool:
        return self.add_facts([fact], topic) == 1

    def add_document(self, entity_id: int, data: bytes | None = None, vector=None, metadata: dict[str, Any] | None = None, topic: int | None = None) -> None:
        self.update(lambda tx: tx.add_document(entity_id, data, vector, metadata, topic))

    def delete_document(self, entity_id: int) -> None:
        self.update(lambda tx: tx.delete_documents([entity_id]))

    def delete_subjects(self, subjects: Iterable[str], topic: int | None = None) -> None:
        self.update(lambda tx: tx.delete_subjects(subjects, topic))

    def set_topic(self, topic: int) -> None:
        self._save({**self.manifest, "version": self.manifest["version"] + 1, "topic": valid_topic(topic)})

    def merge(self, other: DataFrame) -> None:
        """Facts of another source that aren't here yet."""
        self.update(lambda tx: tx.add_frame(other.join(self.facts().select(*FACT_KEY), FACT_KEY, "left_anti"), count=False))

    def reset(self) -> None:
        if self.read_only:
            raise ReadOnly("the store is read-only")
        self._save({**self.manifest, "version": self.manifest["version"] + 1, "seq": 0, "topic": DEFAULT_TOPIC, "log": []})
        self._sweep()

    def set_retention(self, most: int) -> None:
        """Keep at most ``most`` facts from now on (0: all), the last in key order; applied by ``compact``."""
        if most < 0:
            raise StoreError("retention can't be negative")
        self._save({**self.manifest, "version": self.manifest["version"] + 1, "retention": most})

    def compact(self, drop_deprecated: bool = False, files: int | None = None) -> None:
        """Rewrite the snapshot without deleted, overwritten, expired and (optionally) deprecated rows; remove files no snapshot uses."""
        if self.read_only:
            raise ReadOnly("the store is read-only")
        before = self.manifest["log"]
        order = ["topic_id", "predicate", "subject"]

        def ranged(df: DataFrame) -> DataFrame:
            # by range, so that a predicate of a third of all facts is cut over many tasks and files
            return df.repartitionByRange(*order) if files is None else df.repartitionByRange(files, *order)

        # before equal facts are looked for, as the sample that the ranges come from takes all that is below; ranges keep equal facts together
        facts = self._last(ranged(self._table("facts", before)), [*order, *[c for c in FACT_KEY if c not in order]])
        facts = maintenance.drop_deprecated(facts) if drop_deprecated else facts
        if self.manifest["retention"]:
            facts = ranged(maintenance.retain(facts, self.manifest["retention"]))
        facts = facts.withColumn("order_", F.lit(0).cast("bigint")).sortWithinPartitions(*order)
        log = []
        for name, df in (("facts", facts), ("vectors", self.vectors().withColumn("seq_", F.lit(-1).cast("bigint"))), ("content", self.content())):
            file = f"{name}-{uuid4().hex}"
            if name == "facts":
                df.write.partitionBy("topic_id", "predicate").parquet(f"{self.path}/{file}")
            else:
                (df if files is None else df.coalesce(files)).write.parquet(f"{self.path}/{file}")
            log.append({"table": name, "op": "add", "file": file, **({"parts": True, "set": True} if name == "facts" else {})})
        self._save({**self.manifest, "version": self.manifest["version"] + 1, "log": log})
        self._sweep(log, before)  # those who opened the version before may still read it


class Transaction:
    """Staged changes, visible to this transaction's reads; committed together on leaving the ``with`` block."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.log = list(store.manifest["log"])
        self.seq = store.manifest["seq"]
        self.files: list[str] = []
        self.dimension = store.manifest["dimension"]
        self.hooks: list[Callable[[], None]] = []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_: Any) -> None:
        if kind is not None:
            self.rollback()
            return
        if self.files or self.log != self.store.manifest["log"]:
            m = self.store.manifest
            try:
                self.store._save({**m, "version": m["version"] + 1, "seq": self.seq, "dimension": self.dimension, "log": self.log})
            except Exception:
                self.rollback()
                raise
            if len(self.log) > self.store.compact_after:
                self.store.compact()
        for h in self.hooks:
            h()

    def rollback(self) -> None:
        for f in self.files:
            self.store._fs.delete(self.store._p(f), True)

    def on_commit(self, hook: Callable[[], None]) -> None:
        self.hooks.append(hook)

    def _write(self, table: str, op: str, df: DataFrame, **more: Any) -> None:
        file = f"{table}-{op}-{uuid4().hex}"
        self.files.append(file)
        df.write.parquet(f"{self.store.path}/{file}")
        self.log = [*self.log, {"table": table, "op": op, "file": file, **more}]

    def facts(self) -> DataFrame:
        return self.store._facts(self.log)

    def content(self) -> DataFrame:
        return self.store._content(self.log)

    def vectors(self) -> DataFrame:
        return self.store._vectors(self.log)

    def scan(self, s=None, p=None, o=None, topic: int | None = None) -> DataFrame:
        return scan.scan(self.facts(), s, p, o, topic)

    def exists(self, s=None, p=None, o=None, topic: int | None = None) -> bool:
        return scan.exists(self.facts(), s, p, o, topic)

    def add_facts(self, facts: Iterable[Fact | tuple] | DataFrame, topic: int | None = None) -> int:
        if isinstance(facts, DataFrame):
            return self.add_frame(facts)
        rows = list(facts)
        if not rows:
            raise InvalidFact("no facts")
        df = facts_df(self.spark, rows, topic if topic is not None else self.store.topic)
        who = {f.subject if isinstance(f, Fact) else f[0] for f in rows}
        return self._add(df, F.col("ingest_seq") + self.seq, len(rows), self.facts().where(F.col("subject").isin(*who)) if len(who) <= 1000 else self.facts())

    def add_frame(self, df: DataFrame, count: bool = True) -> int | None:
        """Insert or overwrite the rows of a table as one write; of equal facts in it the one with the largest ``ingest_seq`` stays.

        Returns how many were new; that takes a join with the store, so None if ``count`` is False.
        """
        return self._add(df, F.lit(self.seq).cast("bigint"), 1, self.facts() if count else None)

    def _add(self, df: DataFrame, seq, n: int, known: DataFrame | None) -> int | None:
        bad = (F.col("subject") == "") | (F.col("predicate") == "") | F.col("subject").isNull() | F.col("predicate").isNull() | F.col("o_text").isNull()
        new = None if known is None else df.select(*FACT_KEY).distinct().join(known.select(*FACT_KEY), FACT_KEY, "left_anti").count()
        lost = [F.lit(None).cast(f.dataType).alias(f.name) for f in FACTS.fields if f.name not in df.columns]
        df = df.select("*", *lost).withColumn("order_", F.coalesce("ingest_seq", F.lit(0)).cast("bigint")).withColumn("ingest_seq", seq)
        seen, log = Observation(), self.log  # as it's written, so that the table is computed once
        self._write("facts", "add", df.observe(seen, F.count_if(bad).alias("bad")).select(*[f.name for f in FACTS.fields], "order_"))
        if seen.get["bad"]:
            self.store._fs.delete(self.store._p(self.files.pop()), True)
            self.log = log
            raise InvalidFact("subject and predicate must be non-empty, the object non-null")
        self.seq += n
        return new

    def delete_subjects(self, subjects: Iterable[str], topic: int | None = None) -> None:
        t = topic if topic is not None else self.store.topic
        self.delete_frame(self.spark.createDataFrame([(t, s) for s in subjects], "topic_id int, subject string"))

    def delete_frame(self, subjects: DataFrame) -> None:
        """Delete the facts of a table of subjects (topic_id, subject)."""
        self._write("facts", "delete", subjects.select("topic_id", "subject").distinct(), keys=["topic_id", "subject"])

    def set_content(self, entity_id: int, data: bytes) -> None:
        self._write("content", "add", self.spark.createDataFrame([(entity_id, bytearray(data), self.seq)], CONTENT))
        self.seq += 1

    def add_content_frame(self, df: DataFrame) -> None:
        """Contents from a table (entity_id, data) as one write."""
        self._write("content", "add", df.select(F.col("entity_id").cast("bigint"), F.col("data").cast("binary"), F.lit(self.seq).cast("bigint").alias("ingest_seq")))
        self.seq += 1

    def add_vector_frame(self, df: DataFrame) -> None:
        """Vectors from a table (entity_id, topic_id, embedding, semantic_hash) as one write; an id must not repeat in it."""
        r = df.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
        if r["b"] is not None:
            self.dimension = self.dimension or r["b"]
            if (r["a"], r["b"]) != (self.dimension, self.dimension):
                raise DimensionMismatch(f"vectors must have {self.dimension} dimensions, not {r['a']} to {r['b']}")
        self._write("vectors", "add", df.select("entity_id", "topic_id", "embedding", "semantic_hash", F.lit(self.seq).cast("bigint").alias("seq_")))
        self.seq += 1

    def add_vectors(self, rows: Iterable[tuple[int, Any]], topic: int | None = None, semantic_hash: int = 0) -> None:
        t = topic if topic is not None else self.store.topic
        out = []
        for i, v in rows:
            v = [float(x) for x in v]
            self.dimension = self.dimension or len(v)
            if len(v) != self.dimension:
                raise DimensionMismatch(f"vectors must have {self.dimension} dimensions, not {len(v)}")
            out.append((i, t, v, semantic_hash, self.seq + len(out)))
        self.seq += len(out)
        self._write("vectors", "add", self.spark.createDataFrame(out, TABLES["vectors"]))

    def delete_vectors(self, ids: Iterable[int]) -> None:
        self._write("vectors", "delete", self.spark.createDataFrame([(i,) for i in ids], "entity_id bigint"), keys=["entity_id"])

    def add_document(self, entity_id: int, data: bytes | None = None, vector=None, metadata: dict[str, Any] | None = None, topic: int | None = None) -> None:
        t = valid_topic(topic if topic is not None else self.store.topic)
        if metadata:
            self.add_facts([Fact(f"doc:{entity_id}", k, v) for k, v in metadata.items()], t)
        if vector is not None:
            self.add_vectors([(entity_id, vector)], t)
        if data is not None:
            self.set_content(entity_id, data)

    def delete_documents(self, ids: Iterable[int], topic: int | None = None) -> None:
        """Content, vector and facts of documents; unknown ids are no error."""
        self.delete_document_frame(self.spark.createDataFrame([(i,) for i in ids], "entity_id bigint"), topic)

    def delete_document_frame(self, ids: DataFrame, topic: int | None = None) -> None:
        """The same for a table of ids (entity_id)."""
        ids = ids.select(F.col("entity_id").cast("bigint")).distinct()
        for table in ("vectors", "content"):
            self._write(table, "delete", ids, keys=["entity_id"])
        t = topic if topic is not None else self.store.topic
        self.delete_frame(ids.select(F.lit(t).cast("int").alias("topic_id"), F.concat(F.lit("doc:"), F.col("entity_id").cast("string")).alias("subject")))


