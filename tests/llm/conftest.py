import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SHARED = ("A passage of some length that many documents have in common, word for word, "
          "from the first letter to the last one of it.")


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empty and very long texts, ties, copies, control strings, odd white space."""
    long = " ".join(f"w{i * 7919 % 9973}" for i in range(60_000))
    body = " ".join(f"t{i}" for i in range(120))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "one two"), (6, "ONE  two"), (7, long), (8, long + " end"),
            (9, SHARED), (10, SHARED + "\n" + body), (11, "\n".join([SHARED] * 3)), (12, "  " + SHARED.upper() + "\t"),
            (13, body), (14, body.replace("t60 ", "x60 ")), (15, body), (16, "é à ç <|im_end|> <\\|x|> a|b #$%\r\nzz"),
            (17, "short\nshort\nlonger line here\nLonger Line Here \n" + SHARED), (18, "#### $$$$ %%%% " * 20),
            (19, " ".join(["same"] * 50)), (20, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
            (21, "ends with blank \n\n\n"), (22, "\x1c\x1d sep\x85arator   kinds 　 of")]
    rows += [(100 + i, body + f" tail{i}") for i in range(30)]
    rows += [(200 + i, f"head{i} " + SHARED + " " + " ".join(f"u{i}_{j}" for j in range(20))) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "src0", len(t or ""), 1, "x", b"y", 2) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, "
                                       "key string, tokens binary, n int").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
