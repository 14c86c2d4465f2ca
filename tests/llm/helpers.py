"""Small corpora that the operators' tests share."""

import random

#: Extra columns clash with names that operators might use inside.
CLASHING = "slot kept_id gone_id m_id m_copy m_copies secrets k key id a b n row found kept component_id class_id place tokens domain shard digest".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 7))) for _ in range(n))


def make(spark, texts, lang="en", source="src1", ids=None):
    more = tuple(f"own {c}" for c in CLASHING)
    rows = [(i, t, lang, source, len(t or ""), *more) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def corpus():
    rng = random.Random(4)
    base = [words(rng, n) for n in (60, 80, 200, 30, 120)]
    near = base[1].split()
    near[40] = "changed"
    shared = words(rng, 40)
    return [*base, base[0], " ".join(near), None, "", "  \n ", "one two", "one two", f"{shared} {words(rng, 60)}", f"{shared} {words(rng, 60)}", "x" * 5000, "漢字 é\n\tb"]


def rows(df):
    return {r[0]: r.asDict() for r in df.collect()}
