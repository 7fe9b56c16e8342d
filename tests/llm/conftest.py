import random

import pytest

#: Extra columns whose names the operators use inside.
CLASHING = (
    "row", "key", "block", "part", "bucket", "spans", "ids", "hash", "label", "name", "rep", "hub", "text_key", "owner",
    "answers", "kept", "component", "n", "a", "b", "u", "v", "score", "decoded", "said", "seq", "start", "doc",
)


def sentence(rng, n):
    syllables = ["ka", "lo", "mi", "ter", "ou", "é", "ßen", "tion", "ra", "ng", "qu", "st"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def hard_texts():
    """Texts with copies, near copies, shared passages, runs, odd characters, and one very long text."""
    rng = random.Random(3)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(12)]
    passage = sentence(rng, 40)
    near = base[0].split(" ")
    near[50 % len(near)] = "changed"
    texts = [
        *base,
        base[0],
        base[0],
        " ".join(near),
        base[1] + " " + passage,
        passage + "\n" + base[2],
        base[3] + passage + " " + passage,
        "word " * 300,
        "word " * 300 + "end",
        "a" * 500,
        "a" * 700,
        "one two three",
        "one two three",
        "One TWO three",
        "",
        " \n\t ",
        "naïve 日本語テキスト 🙂🙂 \x01\x02 İstanbul ΑΣ <|endoftext|> <s> ▁▁x",
        "It's 3½ o'clock!!! ... \x1c\x1d x\x0by",
        sentence(rng, 20_000),
    ]
    texts.append(texts[-1][:3000])
    return texts


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with every hard case, ids in mixed order, a null text, a null id, and clashing extra columns."""
    texts = hard_texts()
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    rows = [(i, texts[i], "en", f"src{i % 3}", len(texts[i])) for i in order]
    rows += [(900, None, None, None, None), (None, "alone with no id and quite a few words in it", "en", "src1", 44)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, columns)
    for c in CLASHING:
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df.repartition(3)


@pytest.fixture(scope="session")
def plain():
    """The same as (doc_id, text) in order of the id, without the null id."""
    return [*enumerate(hard_texts()), (900, "")]


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
