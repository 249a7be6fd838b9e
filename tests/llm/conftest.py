import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stayline.llm.common import importable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, found string, _key string"


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def ids_of(byte_bpe):
    model = Tokenizer.from_file(byte_bpe)
    return lambda text: np.array(model.encode(text or "", add_special_tokens=False).ids, "<u4")


PASSAGE = " ".join(f"passage{i} of words" for i in range(40))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and long texts, repeated rows and ids."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    texts = [None, "", "  \n ", "a", "the cat's été <|endoftext|> sat", "the cat's été <|endoftext|> sat", long,
             f"before {PASSAGE} after", f"other {PASSAGE}\nend 漢字", f"other {PASSAGE}\nend 漢字", "12 34 !!", "x" * 900]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, None, 11]
    return [(i, t, None if i == 3 else "en" if (i or 0) % 2 else "fr", None, len(t or ""), 1, "x", "y")
            for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    """As a written table: some operators need the same rows at each evaluation."""
    path = str(tmp_path_factory.mktemp("odd") / "t")
    spark.createDataFrame(odd_rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
