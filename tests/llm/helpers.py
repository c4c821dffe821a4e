"""Small inputs with the awkward cases every operator must stand."""
import random

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, spans string, "
              "component long, id string, row string, runs string, blob string, h1 long, sig long, g int")


def docs_frame(spark, texts):
    """Rows of ``documents`` from [(doc_id, text)] with null and clashing further columns."""
    rows = [(i, t, None if k % 5 == 0 else "en", None, None, 0.5, "x", 7, "y", "z", "r", "b", 1, 2, 3)
            for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def word_salad(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def find_components(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}
