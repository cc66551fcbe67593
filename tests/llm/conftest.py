import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""
    import random

    r = random.Random(11)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ke", "tu", "ré", "zö") for b in ("n", "s", "rta", "vil", "q")]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = prose(120), prose(60)
    near = base.split(" ")
    near[60] = "changed"
    texts = [base, base, " ".join(near), None, "", " \n ", "one two", passage + "\n" + prose(40), prose(30) + " " + passage, prose(9000), "ab" * 700, "x", "x", prose(80), "İ日本 <|endoftext|> it's 3×4"]
    texts += [prose(50) + "\nuser 17 logged in from host 9\nAll rights reserved today friends" for _ in range(5)]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[13])  # a repeated row
    rows.append((None, prose(20), None, None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = df.withColumns({c: F.lit("clash") for c in ("key", "doc", "leaf", "row", "band", "at", "a", "shard", "fp")})
    return extra.repartition(3).cache()


@pytest.fixture(scope="session")
def rows(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.collect()]
