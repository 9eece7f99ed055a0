import random
import string
import time

from pyspark.sql import functions as F

from millrace.functions.ready import normalise

SPACES = " \t\n\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def plain(text):
    parts = "".join(" " if c in SPACES else c for c in text).split(" ")
    return " ".join(t for t in (p.strip(string.punctuation).lower() for p in parts) if t)


def seconds(df):
    def once():
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    return min(once() for _ in range(3))


def test_normalise_equals_a_plain_version(spark):
    r = random.Random(3)
    some = [" ", " ", "-", ".", "_", "a", "B", "7", "é", "Ж", "語", "😀", "\x1c", "\u200b", "§", *string.punctuation, *SPACES]
    texts = ["".join(r.choices(some[: r.choice([4, 8, len(some)])], k=r.randrange(14))) for _ in range(5000)]
    texts += ["", " ", "--", " -- ", "(a", "((a b))", "a--", "a -", "- a", "a--b", "-a-.b- ", ". . a", "a . . b", "a .\n.b", "\n", "\na", "a\n", "a\n\n", "-\n"]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "i int, t string")
    got = dict(normalise(df, ["t"]).collect())
    assert [t for i, t in enumerate(texts) if got[i] != plain(t)] == [] and got[len(texts)] is None


def test_normalise_looks_once_through_a_run_of_punctuation(spark):
    run = "a" + "-" * 100_000 + "b"
    df = spark.createDataFrame([(run,)], "t string")
    normalise(spark.createDataFrame([("a",)], "t string"), ["t"]).collect()  # start-up doesn't count
    began = time.perf_counter()
    assert normalise(df, ["t"]).first().t == run
    assert time.perf_counter() - began < 5


def test_normalise_costs_a_few_replacements_of_blanks(spark):
    text = "The quick brown fox, it is said, jumps over a lazy dog; then it rests (for once) near the river. " * 60
    df = spark.range(0, 4000, 1, 4).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("t"))
    took, blanks = seconds(normalise(df, ["t"])), seconds(df.select(F.regexp_replace("t", " ", " ")))
    assert took < 5 * blanks
