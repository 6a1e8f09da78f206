import pytest

WORDS = [f"w{i:03d}" for i in range(400)]


def run_of(first, n, step=7):
    return " ".join(WORDS[(first + step * i) % len(WORDS)] for i in range(n))


@pytest.fixture(scope="session")
def rows():
    """Hostile documents: copies, near copies, shared passages, nulls, empty and long texts, clashing column names."""
    passage = run_of(5, 50, 11)
    out = [(i, run_of(i * 37, 60 + i, 1 + i % 5), f"s{i % 3}") for i in range(30)]
    near = run_of(3, 200, 13).split()
    for i in range(25):  # a large group of near copies, one word apart
        out.append((100 + i, " ".join([*near[: 8 * i], "odd", *near[8 * i + 1 :]]), "s0"))
    out += [(200 + i, f"{run_of(i * 91, 20, 3)} {passage} {run_of(i * 53, 20, 9)}", "s1") for i in range(12)]
    out += [(300 + i, out[2][1], None) for i in range(15)]
    out += [(400, None, "s2"), (401, "", "s2"), (402, " \t\n", None), (403, "one two", "s2"), (404, "ONE two", "s2"), (405, run_of(0, 6000, 17), "s2")]
    out += [(406, "é" * 50, "s9"), (407, "ſ ß Ä cc by", "s9"), (None, passage, "s9"), (1, out[1][1], "s1"), (1, out[1][1], "s1")]
    return out


@pytest.fixture
def docs(spark, rows):
    # Extra columns carry names that the operators use themselves.
    return spark.createDataFrame([(*r, 1, "x", None) for r in rows], "doc_id long, text string, source string, n int, sig string, rows string")


@pytest.fixture
def no_docs(docs):
    return docs.where("false")
