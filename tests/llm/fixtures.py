"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                          # Names that operators use themselves.
                          *[T.StructField(n, T.StringType()) for n in ("size", "copies", "score", "label", "spans", "band", "h", "class_id", "found", "votes", "p", "_h")]])


def odd_texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    edited = base.split()
    edited[60] = "changed"
    long = prose(60_000)
    return [
        None, "", " \n\t ", "!!! ???", "One.", "one two three four", base, base, base.upper(), " ".join(edited), prose(80), long, "x" * 150_000, "7" * 30_000, "1." * 20_000 + "5",
        "a@b" + ".c" * 5_000, "\n".join(["same line here"] * 40), "é😀 naïve 😀 user.name+tag@exa-mple.co.uk, then a@b.c%d@e.f x@y",
        "ip 1.2.3.4 and 1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.002.003.0255 end 9.9.9",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111 and 12345678 1234 5678",
        "call +1 (415) 555-2671 or +49 30 1234567. or +12 or ++3 33333333) +44 20 7946 0958 ext 12345678901234567890",
        "mail john (at) example.com or jane@localhost or 10.0.0.1:8080 or 999.999.999.999",
        'password = "hunter2222" Secret:abc token:token:abcdefgh API_KEY=AAAA.bbbb-cccc apikey : short passwd=\'x\' ſecret=abcdefghij',
        "AKIA" + "Z9" * 9 + " AKIAAKIA" + "Q" * 13 + " AKIA" + "7" * 3 + " deadbeef" * 2 + " " + "0123456789abcdef" * 3 + "G" + "ab" * 12,
        "blob " + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64)) + " and aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1",
        "a b c a b c x y z a b\tc\x0bq", "tab\tsep\x1cnot space\x85nel\u00a0nbsp\u2003em", "#*$%&|<> " * 30 + "end", "w " * 49, "u v w " * 20,
        "<s>[INST]user[/INST]<\\s> \\</s>", "\x00 null byte \x00", "Ünïcödé ÀÉ straße İstanbul ǅ", "🙂" * 50, "مرحبا بالعالم نص", "12345 67890",
    ]


def odd_documents(spark):
    texts = odd_texts()
    langs, sources = ["en", "de", None, "fr"], ["s1", None, "s2", "", "😀"]
    rows = [(None if i == 10 else i, t, langs[i % 4], sources[i % 5], len(t) if t and i % 2 else None, *["x"] * 12) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[0], (3, "One.", "en", "s1", None, *["y"] * 12)]
    return spark.createDataFrame(rows, DOCUMENTS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(36)] + [(None, 1, 0), (5, None, None), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    base = odd_texts()[6].split()
    rows = [(1, " ".join(base[20:45])), (2, "changed"), (None, "One."), (3, None), (4, ""), (5, "!!"), (1, " ".join(base[20:45])), (10, "four three"), (11, "W w w, w w w w w w w W")]
    return spark.createDataFrame(rows, "item_id long, text string")


def embeddings(spark):
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(32)], None if i % 7 == 3 else i % 3, "x") for i in range(90)]
    rows += [rows[5], rows[5], (None, rows[8][1], 1, "y"), (90, None, 1, "x"), (91, [], 0, "x"), (92, [None] * 32, 0, "x"), (93, [float("nan")] * 32, 0, "x"),
             (94, [float("-inf")] + [0.0] * 31, None, "x"), (95, [1.0] * 48, 0, "x"), (96, [-0.0, -1e-9, 1 / 256, 200.0] * 8, 2, "x"), (-3, [0.0] * 32, 2, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")


def write_tables(spark, path):
    """A data set as the queries read it."""
    embeddings(spark).write.parquet(f"{path}/embeddings.parquet")
    odd_documents(spark).write.parquet(f"{path}/documents.parquet")
    labels(spark).write.parquet(f"{path}/labels.parquet")
    benchmark(spark).write.parquet(f"{path}/benchmark.parquet")
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "<\\s> [INST] \\[/INST] <s>"), (1, 3, "user", None), (1, 4, "assistant", "x " * 4000),
            (1, 5, "assistant", "tail"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (2, None, "tool", "r"), (None, 1, "user", "q"), (None, 2, "assistant", "a😀"),
            (3, 1, None, None), (4, 1, "system", "only"), (5, 1, "user", "u1"), (5, 2, "system", "late"), (5, 3, "assistant", "a2")]
    rows += [(6, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i % 90)) for i in range(120)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)
