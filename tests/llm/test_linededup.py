import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsewright.llm import linededup as L


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. !\n\ue000?", max_size=80))
def test_units_join_to_the_text(text):
    assert "".join(L.units(text)) == text


def longest(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    return max(best, default=0)


def test_longest_increasing_run():
    rng = random.Random(1)
    for _ in range(300):
        values = [rng.randrange(12) for _ in range(rng.randrange(12))]
        run = [values[k] for k in L.increasing(values)]
        assert len(run) == longest(values) and all(a < b for a, b in zip(run, run[1:], strict=False))


def cut_up(text):
    """Units of a text with the words of each, by a pattern of its own; blanks behind a unit are its own."""
    found = re.findall(r"\s*\S(?:(?![\n。！？]|[.!?] )[\s\S])*(?:[\n。！？]|[.!?] |$)\s*", text)
    return [(u, u.split()) for u in found]


def kept_by_difflib_like(pairs):
    """What an alignment keeps, by recursion over slices: anchors, a longest run of them, then what is between them."""
    once = [(h, t) for h, t in pairs if sum(h == x for x, _ in pairs) == 1 == sum(t == y for _, y in pairs)]
    pool = sorted(once) if once else sorted(pairs, key=lambda r: (r[0], -r[1]))
    if not pool:
        return []
    chains = []  # of each match the longest chain that ends there; of equal ones the one whose ends are least, as piles have it
    for h, t in pool:
        before = [c for c in chains if c[-1][1] < t and c[-1][0] < h or not once and c[-1][1] < t and c[-1][0] < h]
        longest_ = max(map(len, before), default=0)
        best = min((c for c in before if len(c) == longest_), key=lambda c: c[-1][1], default=[])
        chains.append([*best, (h, t)])
    longest_ = max(map(len, chains))
    chain = min((c for c in chains if len(c) == longest_), key=lambda c: c[-1][1])
    if not once:
        return chain
    out, ends = list(chain), [(-1, -1), *chain, (10**9, 10**9)]
    for (a, b), (c, d) in zip(ends[:-1], ends[1:], strict=True):
        out += kept_by_difflib_like([(h, t) for h, t in pairs if a < h < c and b < t < d])
    return sorted(out)


def brute(texts, least=32, moved=128):
    """By doc_id: the words left, and those that a plain lookup of the runs would leave."""
    cut = {i: [w for _, w in cut_up(t)] for i, t in texts.items()}
    sizes = {i: [sum(len(x.encode()) for x in w) for w in c] for i, c in cut.items()}
    runs = {}  # of each document: the shortest long enough runs from each unit on and up to each unit, or the whole
    for i, size in sizes.items():
        own = set()
        for a in range(len(size)):
            on = next((n for n in range(1, len(size) - a + 1) if sum(size[a : a + n]) >= least), None)
            up = next((n for n in range(1, a + 2) if sum(size[a - n + 1 : a + 1]) >= least), None)
            own |= ({(a, on)} if on else set()) | ({(a - up + 1, up)} if up else set())
        runs[i] = own or ({(0, len(size))} if size else set())
    owners, out, plain = {}, {}, {}
    whole = {i: not any(sum(size[a:]) >= least for a in range(len(size))) for i, size in sizes.items()}
    for i in sorted(texts):
        key = lambda a, n, i=i: (whole[i], tuple(map(tuple, cut[i][a : a + n])))
        met, looked, times, mine = {}, set(), {}, []
        for a, n in sorted(runs[i]):
            nth = times[key(a, n)] = times.get(key(a, n), -1) + 1
            mine.append((key(a, n), nth, a))
            owner = owners.get((key(a, n), nth))  # a run that comes again meets those that come again elsewhere
            if owner:
                met.setdefault(owner[0], []).append((a, owner[1], n))
                looked |= set(range(a, a + n))
        gone = set()
        for own in met.values():
            kept = set(kept_by_difflib_like(sorted({(h + k, t + k) for h, t, n in own for k in range(n)})))
            loose = {}
            for h, t, n in own:
                if all((h + k, t + k) in kept for k in range(n)):
                    gone |= set(range(h, h + n))
                else:
                    loose.setdefault(t - h, set()).update(range(h, h + n))
            for units in loose.values():
                block = []
                for k in [*sorted(units), None]:
                    if block and (k is None or k > block[-1] + 1):
                        if sum(sizes[i][x] for x in block) >= moved:
                            gone |= set(block)
                        block = []
                    block.append(k)
        for run, nth, a in mine:
            owners.setdefault((run, nth), (i, a))
        started = set(gone)  # repeats within the text of what has gone
        k = 0
        while k < len(cut[i]):
            first = next((g for g in sorted(started) if cut[i][g] == cut[i][k]), None)
            n = 0
            if k not in started and first is not None:
                while k + n < len(cut[i]) and k + n not in started and first + n < k and first + n in gone and cut[i][k + n] == cut[i][first + n]:
                    n += 1
            if n and sum(sizes[i][k : k + n]) >= moved:
                gone |= set(range(k, k + n))
                k += n
            else:
                k += 1
        left = lambda dropped, i=i: [x for k, w in enumerate(cut[i]) if k not in dropped for x in w]
        out[i], plain[i] = left(gone), left(looked)
    return out, plain


def test_matches_brute_force(spark):
    rng = random.Random(7)
    sentences = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 2, 3, 6, 7, 12, 15]))) + rng.choice(".!?") for _ in range(60)]
    texts = {k: rng.choice([" ", "\n", "\n\n", "  "]).join(rng.choice(sentences) for _ in range(rng.randrange(12))) for k in range(120)}
    for k in range(120, 150):
        texts[k] = texts[rng.randrange(120)]
    for k in range(150, 170):  # blocks in another order, and repeated
        parts = texts[rng.randrange(120)].split(". ")
        texts[k] = ". ".join(rng.sample(parts, len(parts)) + parts[:2] + parts[:2])
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want, lookup = brute(texts)
    assert [k for k in texts if got[k].split() != want[k]] == []
    assert any(want[k] != texts[k].split() and want[k] for k in texts)
    assert sum(want[k] != lookup[k] for k in texts) > 5  # the alignment matters


def test_short_lines_and_texts_without_blanks(spark):
    lines = "\n".join(f"a{k} b{k} c{k}" for k in range(60))
    chinese = "".join(f"第{k}句话没有空格。" for k in range(60))
    nine = "nine words of one line stand on two pages"
    rows = [lines, chinese, f"First.\n{nine}\nOne end.", "short", lines, chinese, f"Second!\n{nine}\nOther end.", "short", "shor t"]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(4)] == rows[:4]
    assert [got[k] for k in (4, 5, 6, 7, 8)] == ["", "", "Second!\nOther end.", "", "shor t"]


def test_moved_and_repeated_blocks_go(spark):
    x, y = (" ".join(f"{c}{k}word" for k in range(52)) + "." for c in "xy")
    rows = [(1, f"{x} {y}"), (2, f"{y} {x}"), (3, f"Own. {x} {x} {x}"), (4, "kept " * 20)]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "Own. ", 4: rows[3][1]}


def test_short_lines_in_another_order_stay(spark):
    lines = [f"line {c} has quite a few words of its own here" for c in "abcde"]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["Own text.", lines[0], lines[1], lines[4], lines[2], "More text."])), (3, "\n".join([lines[3], "Own.", lines[3]]))]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: f"Own text.\n{lines[4]}\nMore text.", 3: f"Own.\n{lines[3]}"}


def test_patience_keeps_an_increasing_alignment():
    rng = random.Random(3)
    assert L.patience([(0, 5), (1, 6), (2, 0), (3, 7)]) == [(0, 5), (1, 6), (3, 7)]
    for _ in range(300):
        pairs = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(1, 14))})
        got = L.patience(pairs)
        assert set(got) <= set(pairs) and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))
        assert got == kept_by_difflib_like(pairs)
        once = [(h, t) for h, t in pairs if sum(h == x for x, _ in pairs) == 1 == sum(t == y for _, y in pairs)]
        assert len(got) >= longest([t for _, t in once])


def test_frequent_hashes_take_the_other_join(spark, monkeypatch):
    rows = [(k, f"own{k} line. " + "a line that very many documents have in common here. " * (k % 3)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(L.dedup_lines(docs).collect())
    monkeypatch.setattr(L, "FREQUENT", 0.2)
    assert sorted(L.dedup_lines(docs).collect()) == want and [r.doc_id for r in want if r.text.count("common") == 1 and r.doc_id % 3 == 1] == [1]
    assert [r.doc_id for r in want if r.doc_id % 3 == 2 and "common" in r.text] == [2]  # the first that has it twice keeps one


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "t", 5, 6, 7)], "doc_id long, text string, cut_key_0 long, cut_id_0 long, cut_list_1 long")
    assert L.dedup_lines(docs).collect() == docs.collect()


def test_copies_go_and_other_text_stays(spark):
    passage = "This passage of quite a few words was copied from one page to the next by hand. It goes on for a second sentence of many words."
    rows = [(1, "First page has its own start. " + passage + "\nIts own end is here."), (2, "Second page begins in its own way. " + passage + " And ends otherwise."), (3, "Nothing in common with any other page at all, just words."), (4, passage)]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert "copied" not in got[2] and "second sentence" not in got[2] and "begins in its own way" in got[2] and "ends otherwise" in got[2]
    assert got[4] == ""


def test_odd_rows(odd_docs, odd_rows, no_docs):
    out = L.dedup_lines(odd_docs, removed="gone")
    assert out.columns == [*odd_docs.columns, "gone"] and out.count() == len(odd_rows)
    got = [(r.doc_id, r.text, r.gone) for r in out.collect()]
    texts = {i: t for i, t, *_ in odd_rows}
    assert [t for i, t, _ in got if i == 1] == [None] and [t for i, t, _ in got if i is None] == ["a row without an id"]
    assert [t for i, t, _ in got if i == 5] == [texts[5]] * 2 and [t for i, t, _ in got if i == 6] == [""]
    assert [t.strip() for i, t, _ in got if i == 7][0] in "More words at the very end of it."
    assert L.dedup_lines(no_docs).count() == 0
    with pytest.raises(ValueError, match="already"):
        L.dedup_lines(odd_docs, removed="Hash")
