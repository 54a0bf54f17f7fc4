"""The SQL of the quality rules against the operator where languages are small, or bad for the most part."""

import duckdb
import numpy as np
import pytest

from twinsift.llm import queries
from twinsift.llm.oracles import QUALITY
from twinsift.llm.quality import COMMON_WORDS


def made(rng, kind, n):
    letters = lambda: "".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 9)))
    if kind == "prose":
        words = [rng.choice(COMMON_WORDS) if rng.random() < 0.4 else letters() for _ in range(n)]
    elif kind == "numbers":
        words = [str(rng.integers(1000, 10**9)) for _ in range(n)]
    elif kind == "other":
        words = ["".join(chr(int(c)) for c in rng.integers(0x0430, 0x0450, rng.integers(2, 9))) for _ in range(n)]
    else:
        words = ["".join(rng.choice(list("#$%&|<>*a1"), 6)) for _ in range(n)]
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_sql(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    shares = {"en": [("prose", 60), ("junk", 25), ("numbers", 10)], "de": [("prose", 12), ("junk", 3)], "xx": [("junk", 30), ("prose", 9)],
              "ru": [("other", 21), ("numbers", 8)], "one": [("numbers", 1)], None: [("prose", 5), ("other", 5)], "": [("prose", 19)]}
    rows = [(made(rng, kind, int(rng.integers(80, 300))), lang) for lang, parts in shares.items() for kind, n in parts for _ in range(n)]
    rows += [(None, "en"), ("", "en"), ("a b " * 200, "de"), (rows[0][0], "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op6_quality_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({QUALITY}) ORDER BY doc_id").fetchall()
    assert [tuple(r[c] for c in names) for r in got.orderBy("doc_id").collect()] == want
    kept = [r[names.index("kept")] for r in want]
    assert 0 < sum(kept) < len(kept)
