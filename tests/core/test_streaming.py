import json
import random
import re

from pyspark.sql import functions as F

from fabula.operators.extraction import RuleProvider
from fabula.sources import snapshots
from fabula.sources.files import Files
from fabula.streaming.incremental import CHUNKS, extract_continuously, merge_books, replace_chunks, stored_facts, watch_chunks


def lines():
    class Lines:
        """Facts as the text lists them: ``name kind value [other name]``, one a line."""

        def complete(self, text, family):
            if "fail" in text:
                raise ValueError("no answer")
            facts = []
            for line in filter(None, text.split("\n")):
                name, kind, value, *other = re.split(r" +", line)
                facts.append({"type": f"CHARACTER_{kind}", "entityName": name, "confidence": 0.75, "value": {"summary": value, "candidateNames": other}})
            return json.dumps({"facts": facts})

    return Lines()  # of a local class, so that tasks get it by value


def run(spark, folder, store, chunks, provider=None, merged=None):
    spark.createDataFrame(chunks, CHUNKS).write.mode("append").parquet(folder)
    extract_continuously(watch_chunks(spark, folder), provider or RuleProvider(), store, f"{folder}-cp", once=True, merged=merged).awaitTermination()


def names(spark, store):
    return sorted(r.entity_name for r in stored_facts(spark, store).collect())


def test_chunks_replace_their_own_facts_over_several_batches(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "facts")
    want = [["Anna Karenina"], ["Anna Karenina", "Kitty Levin"], ["Anna Karenina"], [], ["Kitty Levin"]]
    chunks = [("c1", "Anna Karenina"), ("c2", "Kitty Levin"), ("c2", "nobody"), ("c1", ""), ("c1", "Kitty Levin")]
    for (chunk, text), found in zip(chunks, want, strict=True):
        run(spark, folder, store, [(chunk, 1, text, None, None)])
        assert names(spark, store) == found


def test_failed_chunks_keep_their_facts_and_a_batch_may_repeat(spark, tmp_path):
    store = str(tmp_path / "facts")
    make = lambda *rows: spark.createDataFrame(rows, CHUNKS)
    replace_chunks(make(("a", 1, "Ann AGE 20", 0, 0), ("b", 1, "Bob AGE 30", 0, 1), (None, 2, "Cid AGE 40", 0, 0)), lines(), store)
    for _ in range(2):
        replace_chunks(make(("a", 1, "fail", 0, 0), ("b", 1, "", 0, 1)), lines(), store)
    assert names(spark, store) == ["Ann", "Cid"]


def books():
    r = random.Random(3)
    rows = []
    for book in (1, 2, 3):
        for i in range(6):
            lines = [f"{r.choice(['Ann', 'Bob', 'Cid', 'ANN'])} {r.choice(['AGE', 'APPEARANCE', 'MENTION', 'PLOT_CHANGE'])} v{r.randrange(3)} {r.choice(['', '', 'Anna', 'Bobby'])}".strip() for _ in range(4)]
            rows.append((f"{book}-{i}", book, "\n".join(lines), i // 2, i))
    return rows


def tables(spark, store):
    now = snapshots.snapshot(spark, store)
    return {t: sorted(str(tuple(r[c] for c in sorted(r.asDict()))) for r in now.table(t).collect()) for t in ("characters", "versions", "attribute_conflicts", "possible_duplicates")}


def test_any_order_of_arrival_gives_the_merge_of_all(spark, tmp_path):
    rows = books()
    once = str(tmp_path / "once")
    replace_chunks(spark.createDataFrame(rows, CHUNKS), lines(), f"{once}/facts")
    merge_books(spark, f"{once}/facts", f"{once}/merged", spark.createDataFrame(rows, CHUNKS))
    want = tables(spark, f"{once}/merged")
    assert all(want[t] for t in ("characters", "versions", "attribute_conflicts"))
    for seed in (1, 2):
        at = str(tmp_path / f"s{seed}")
        shuffled = random.Random(seed).sample(rows, len(rows))
        wrong = (shuffled[0][0], shuffled[0][1], "Zoe AGE 1", 0, 0)  # the right text of this chunk comes later
        for part in ([wrong, *shuffled[1:7]], shuffled[7:], shuffled[:1]):
            run(spark, f"{at}/in", f"{at}/facts", part, lines(), f"{at}/merged")
        assert tables(spark, f"{at}/merged") == want


def test_a_batch_writes_its_own_facts_only(spark, tmp_path):
    store = str(tmp_path / "facts")
    rows = books()
    replace_chunks(spark.createDataFrame(rows, CHUNKS), lines(), store)
    before = set(Files(spark, store).names(f"{store}/data"))
    replace_chunks(spark.createDataFrame(rows[:1], CHUNKS), lines(), store)
    (new,) = set(Files(spark, store).names(f"{store}/data")) - before
    assert spark.read.parquet(f"{store}/data/{new}/facts").count() == 4
    assert stored_facts(spark, store).count() == 4 * len(rows)
    snapshots.compact(spark, store)
    assert snapshots.vacuum(spark, store) == 2
    assert stored_facts(spark, store).groupBy("chunk_id").agg(F.count("*").alias("n")).where("n <> 4").count() == 0
