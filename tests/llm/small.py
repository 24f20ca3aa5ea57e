"""Small tables with every odd case."""

import random

SCHEMA = "doc_id long, text string, _did int, n int, `key` string, _text string, lang string"


def corpus(seed=5):
    """Prose with copies, near copies, shared passages, odd bytes, nulls and long texts."""
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "é", "naïve", "Straße", "X"] + ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, texts = say(60), []
    for _ in range(12):
        texts.append(say(rng.randint(1, 160)))
    base = say(130)
    for k in range(14):  # one group of near copies
        w = base.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"edit{k}{rng.random()}"
        texts.append(" ".join(w))
    texts += [say(30) + "\n" + passage + "\t" + say(20), passage, passage.upper(), "a " * 150, "ab" * 400, "x\x00y " * 60, "é" * 300]
    short = say(14).split()
    texts += [" ".join(short), " ".join([*short, "tail"]), " ".join(short[:11]), "one two", "one", " \n\t "]
    texts.append(say(4000) + " " + passage)
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    rows += [(2, texts[5]), (900, texts[5]), (901, texts[5]), (902, None), (903, ""), (904, base), (904, base)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """Also with further columns, some named like internal ones."""
    return spark.createDataFrame([(d, t, 7, 8, "k", "other", None) for d, t in rows], SCHEMA).repartition(3)
