"""A small table with what the operators must bear: nulls, empty and long texts, copies, ties, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text string, size long, __bucket int"


def documents(spark, empty: bool = False):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(n))
    passage, copied = text(60), text(90)
    texts = [None, "", "   \n\t ", "one", text(20), text(20000), copied, copied, copied + " end", "x " + passage + " y " + text(5), text(7) + "\n" + passage, passage, "Shti " * 300, "Shti " * 300, text(300), "日本語 テキスト", "🙂", "a\x0bb\x0cc\rd"]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s1"][i % 4], None if t is None else len(t), "other", 7, 1) for i, t in enumerate(texts)]
    rows += [(None, copied, "en", "s1", 1, "other", 7, 1), (None, None, None, None, None, None, None, None), (6, copied, "en", "s1", 1, "other", 7, 1)]
    return spark.createDataFrame([] if empty else rows, SCHEMA)
