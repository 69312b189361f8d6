"""An index that grows: micro-batches append shards, compaction merges them by generation.

Every micro-batch of a stream becomes one shard of generation 0. When a generation holds
``radix`` shards, they are rewritten as one of the next: each document is rewritten a number of
times logarithmic in the size of the index. A query reads the shards a manifest names; a
manifest replaces the last one only when its shards are complete, so readers never see half a
batch, and a batch run again after a failure replaces its own shard.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.index import TABLES, Index, build, build_from, merge, tokenized


class GrowingIndex:
    """Index under one folder of a file system all executors share."""

    def __init__(self, spark: SparkSession, path: str, radix: int = 3, docid: str = "doc_id", text: str = "text"):
        self.spark, self.path, self.radix, self.docid, self.text = spark, path.rstrip("/"), radix, docid, text

    # --- the manifest, a few lines of JSON -------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def shards(self) -> list[dict]:
        """[{name, generation}] in order of age."""
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p))
        if not names:
            return []
        f = fs.open(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, names[-1]))
        try:
            data = bytes(f.readAllBytes())
        finally:
            f.close()
        return json.loads(data.decode())

    def _publish(self, shards: list[dict]) -> None:
        fs, p = self._fs(f"{self.path}/manifest")
        fs.mkdirs(p)
        last = sorted(s.getPath().getName() for s in fs.listStatus(p))
        number = int(last[-1]) + 1 if last else 0
        jvm = self.spark.sparkContext._jvm
        made = jvm.org.apache.hadoop.fs.Path(f"{self.path}/.manifest-{number:010d}")
        out = fs.create(made, True)
        try:
            out.write(bytearray(json.dumps(shards).encode()))
        finally:
            out.close()
        fs.rename(made, jvm.org.apache.hadoop.fs.Path(p, f"{number:010d}"))

    # --- writing -----------------------------------------------------------------------------------

    def add(self, documents: DataFrame, batch: int | None = None) -> None:
        """Index a batch of documents as a shard, then compact where a generation is full."""
        known = self.shards()
        number = batch if batch is not None else sum(s["name"].startswith("b") for s in known)
        name = f"b{number:010d}"
        if any(name in s.get("from", [s["name"]]) for s in known):
            return  # the stream runs a batch again that is already in
        build_from(documents, self.docid, self.text).save(f"{self.path}/{name}")
        self._publish([*known, {"name": name, "generation": 0, "from": [name]}])
        self.compact()

    def compact(self) -> None:
        while True:
            shards = self.shards()
            full = next((g for g in sorted({s["generation"] for s in shards}) if sum(s["generation"] == g for s in shards) >= self.radix), None)
            if full is None:
                return
            old = [s for s in shards if s["generation"] == full]
            name = f"g{full + 1}-{old[0]['name']}"
            merge([Index.open(self.spark, f"{self.path}/{s['name']}") for s in old]).save(f"{self.path}/{name}")
            new = {"name": name, "generation": full + 1, "from": [x for s in old for x in s["from"]]}
            at = shards.index(old[0])
            self._publish([*[s for s in shards[:at] if s not in old], new, *[s for s in shards[at:] if s not in old]])

    def clean(self) -> None:
        """Delete shards no manifest names any more; run it when no query reads an older one."""
        fs, p = self._fs(self.path)
        keep = {s["name"] for s in self.shards()} | {"manifest", "checkpoint"}
        for s in fs.listStatus(p):
            if s.getPath().getName() not in keep and not s.getPath().getName().startswith("."):
                fs.delete(s.getPath(), True)

    def start(self, stream: DataFrame, **options):
        """Begin to index a stream of documents; returns the streaming query. A batch that fails
        and runs again has the same number, so no document is indexed twice."""
        w = stream.writeStream.foreachBatch(lambda df, n: self.add(df, n)).option("checkpointLocation", f"{self.path}/checkpoint")
        for k, v in options.pop("trigger", {"availableNow": True}).items():
            w = w.trigger(**{k: v})
        return w.start()

    # --- reading -----------------------------------------------------------------------------------

    def index(self) -> Index:
        """All shards as one index."""
        shards = self.shards()
        if not shards:
            empty = self.spark.createDataFrame([], f"`{self.docid}` bigint, `{self.text}` string")
            return build(tokenized(empty, self.docid, self.text))
        return merge([Index.open(self.spark, f"{self.path}/{s['name']}") for s in shards])


def streamed_term_counts(stream: DataFrame, docid: str = "doc_id", text: str = "text") -> DataFrame:
    """Streaming (term, cf, df), for ``complete`` or ``update`` output: df counts each record once
    as long as a document arrives once."""
    from scriptorium.functions.text import simple_tokens

    t = stream.where(F.col(docid).isNotNull()).select(simple_tokens(F.col(text)).alias("t"))
    # a document's words are counted in its own row, so that no state per document is kept
    each = t.select(F.explode(F.array_distinct("t")).alias("term"), "t")
    own = F.size(F.filter("t", lambda x: x == F.col("term"))).cast("bigint")
    return each.select("term", own.alias("tf")).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


__all__ = ["TABLES", "GrowingIndex", "streamed_term_counts"]
