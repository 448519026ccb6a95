import random

from brute import kept_lines

from cartloom.llm import op8_line_dedup as d


def test_equals_brute_force(docs, rows):
    got = {r.doc_id: (r.kept_text, r.n_removed_lines, r.n_removed_chunks) for r in d.dedup_lines(docs).collect()}
    want = dict(zip([r[0] for r in rows], kept_lines([r[1] for r in rows]), strict=True))
    assert got == want and sum(w[1] for w in want.values()) > 10


def test_boundaries_resist_shifts():
    from brute import chunk_spans

    body = [f"line {i} of a passage" for i in range(60)]
    chunks = lambda lines: {tuple(lines[a : a + n]) for a, n in chunk_spans("\n".join(lines))}
    plain, shifted = chunks(body), chunks(["something else", "in front", *body])
    assert len(plain & shifted) >= len(plain) - 2


def test_odd_input(spark, odd_docs, no_docs):
    out = d.dedup_lines(odd_docs)
    assert out.count() == 5
    assert d.dedup_lines(no_docs).collect() == []
    stage = d.stage(spark, odd_docs, "")
    assert stage.columns == odd_docs.columns and stage.filter("text IS NULL").count() == 2


def plain_runs(texts):
    """Lines with words that lie in a run of two such lines or more which stood at an earlier place, by comparing every run."""
    seen, out = set(), []
    for text in texts:
        lines = [] if text is None else text.split("\n")
        worded = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for a in range(len(worded)):
            for b in range(a + 1, len(worded)):
                run = tuple(lines[worded[a] : worded[b] + 1])
                if run in seen:
                    gone.update(worded[a : b + 1])
                seen.add(run)
        out.append([lines[i] for i in worded if i not in gone])
    return out


def test_every_repeated_run_of_lines_goes(spark):
    pick = random.Random(5)
    line = lambda: " ".join(pick.choice("abcdefgh") * pick.randint(1, 3) for _ in range(6))
    passages = [[line() for _ in range(n)] for n in (2, 2, 3, 3, 4, 6, 9) for _ in range(4)]
    passages += [[*p[:1], "", *p[1:]] for p in passages[:6]]
    texts = ["\n".join([line() for _ in range(2)] + p + [line() for _ in range(3)]) for p in passages for _ in range(3)]
    texts += ["\n".join([*passages[20][2:7], *passages[3]]), "\n\n" + texts[0] + "\n \n\n", "\n\n" + texts[0] + "\n \n\n", "one line", "one line"]
    got = [r.kept_text for r in d.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [[x for x in t.split("\n") if x.strip()] for t in got] == plain_runs(texts)
    assert got[-3:] == ["", "one line", "one line"]
