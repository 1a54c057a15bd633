"""A persistent inverted index of message texts, for searches that read a small part of them.

Texts are folded once, when the index is written.  Every three neighbouring characters of a
folded text are a gram; its postings are the numbers of the messages that have it, in sorted
arrays of one block of messages each, so that a gram of very many messages is many
small rows.  Postings lie in buckets by the first two characters of their gram, sorted by
gram, and texts in parts by message number.  A search opens the buckets of its own grams,
intersects their postings block by block, and checks what is left on the folded texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import fuzzy
from threadlake.operators.ranking import global_index
from threadlake.operators.views import filter_chats, searched_text, snippet

#: Characters of a gram; terms may be one character shorter.
GRAM = 3
#: Stands behind the last character of a text, so that its last two characters begin a gram.
END = "\0"
#: Messages of a block of postings, and blocks of a part of the texts, as powers of two.
BLOCK_BITS, PART_BITS = 12, 8
BUCKETS = 64

TEXTS = (
    "chat_id bigint, msg_idx bigint, ts timestamp_ntz, sender string, hay string, doc bigint, folded string, part bigint"
)
POSTINGS = "block bigint, gram string, docs array<bigint>, bucket int"


def _grams(folded: Column) -> Column:
    """The distinct grams of a text; none if it has only one character."""
    n = F.length(folded)
    closed = F.concat(folded, F.lit(END))
    cut = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(closed, i, F.lit(GRAM)))
    return F.when(n > 1, F.array_distinct(cut))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, GRAM - 1)), F.lit(buckets)).cast("int")


class SearchIndex:
    """An index in a folder; ``write`` makes it, and any session may open it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        #: As the index was written, whatever this module's constants say now.
        self.layout = spark.read.parquet(f"{self.folder}/layout").first()

    @classmethod
    def write(
        cls,
        messages: DataFrame,
        folder: str,
        buckets: int = BUCKETS,
        block_bits: int = BLOCK_BITS,
        part_bits: int = PART_BITS,
    ) -> SearchIndex:
        """Index ``messages``; what is searched in each is its text, or else its file's name.

        Folding runs in Arrow batches, so every term can be found, also one that
        decomposes into several letters.  Texts are shuffled once, by block; grams are
        made behind that shuffle, and only their postings are moved again.
        """
        spark, folder = messages.sparkSession, folder.rstrip("/")
        texts = global_index(
            messages.select("chat_id", "msg_idx", "ts", "sender", searched_text().alias("hay")),
            ["chat_id", "msg_idx"],
            "doc",
        )
        block = F.shiftright("doc", block_bits)
        (
            texts.withColumn("folded", fuzzy.fold_arrow("hay"))
            .withColumn("part", F.shiftright(block, part_bits))
            .repartition(block)
            .sortWithinPartitions("part", "doc")
            .write.partitionBy("part")
            .parquet(f"{folder}/texts")
        )
        gathered = (
            spark.read.schema(TEXTS).parquet(f"{folder}/texts")
            .select(F.shiftright("doc", block_bits).alias("block"), "doc", "folded")
            .repartition("block")
            .select("block", "doc", F.explode(_grams(F.col("folded"))).alias("gram"))
            .groupBy("block", "gram")
            .agg(F.array_sort(F.collect_list("doc")).alias("docs"))
        )
        (
            gathered.withColumn("bucket", _bucket(F.col("gram"), buckets))
            # Blocks apart, so that no task has all of a frequent gram.
            .repartition("bucket", F.shiftright("block", part_bits))
            .sortWithinPartitions("bucket", "gram", "block")
            .write.partitionBy("bucket")
            .parquet(f"{folder}/postings")
        )
        layout = spark.range(1).select(*[F.lit(v).alias(k) for k, v in
                                         (("buckets", buckets), ("block_bits", block_bits), ("part_bits", part_bits))])
        layout.write.parquet(f"{folder}/layout")
        return cls(spark, folder)

    def texts(self) -> DataFrame:
        return self.spark.read.schema(TEXTS).parquet(f"{self.folder}/texts")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings")

    def candidates(self, needle: str) -> DataFrame:
        """``doc`` of the messages that have all grams of a folded term of two characters or more."""
        if len(needle) < GRAM:
            some = self.postings().filter(
                (F.col("bucket") == _bucket(F.lit(needle), self.layout.buckets)) & F.col("gram").startswith(needle)
            )
            return some.select(F.explode("docs").alias("doc")).distinct()
        grams = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
        wanted = F.lit(False)
        for gram in grams:
            wanted = wanted | ((F.col("bucket") == _bucket(F.lit(gram), self.layout.buckets)) & (F.col("gram") == gram))
        blocks = (
            self.postings()
            .filter(wanted)
            .groupBy("block")
            .agg(F.collect_list("docs").alias("lists"))
            .filter(F.size("lists") == len(grams))
        )
        # The shortest list first keeps the intersections small.
        ordered = F.array_sort("lists", lambda x, y: F.size(x) - F.size(y))
        common = F.aggregate(ordered, F.element_at(ordered, 1), lambda kept, docs: F.array_intersect(kept, docs))
        return blocks.select(F.explode(common).alias("doc"))

    def matches(self, needle: str) -> DataFrame:
        """The texts that contain a folded term."""
        if len(needle) < GRAM - 1:
            return self.texts().filter(F.lit(False))
        part = F.shiftright("doc", self.layout.block_bits + self.layout.part_bits)
        found = self.candidates(needle).select("doc", part.alias("part"))
        return self.texts().join(found, ["part", "doc"]).filter(F.contains("folded", F.lit(needle)))

    def search(
        self,
        chats: DataFrame,
        query: str,
        which: str = "all",
        limit: int | None = None,
        messages: DataFrame | None = None,
    ) -> DataFrame:
        """As ``views.search``; ``messages`` are needed only for the filter ``media``."""
        needle = fuzzy.fold_text(query).strip()
        scope = filter_chats(chats, messages, which).select("chat_id", "chat_rank", "title")
        found = self.matches(needle).join(scope, "chat_id")
        if limit is not None:
            found = found.orderBy("chat_rank", "msg_idx").limit(limit)
        return found.select(
            "chat_rank", "chat_id", "title", "msg_idx", "ts", "sender", snippet(F.col("hay"), needle).alias("snippet")
        )
