"""Documents with every awkward case, and plain words for brute force."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, size long, host string, score double"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def awkward_rows(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgéß") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    line = prose(14)
    texts = [base, base, " ".join(near), base.upper(), prose(80) + " " + base, None, "", "   \n\t ", "one", "a b c d", "a b c d e", line + "\n" + prose(50), line + "\n" + line + "\n" + prose(40)]
    texts += [prose(r.randint(1, 60)) for _ in range(12)] + [prose(20_000), "x" * 5000, "ab " * 400, "tab\x0bsep\x0cpage\rcarriage  two  spaces", "😀 emoji ü <|endoftext|> end", "nul\x00inside text"]
    rows = [(i, t, "en", r.choice(["s1", "s2", "s3", None, ""]), len(t or ""), 7, 7, "h", 0.5) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (1000, prose(30), "en", "s1", 1, 1, 1, "h", 0.1)]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)
