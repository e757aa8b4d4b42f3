import random
from collections import Counter

import xxhash

from fieldscan.llm.linedup import cut_lines, dedup_lines
from tests.llm.conftest import EDGES


def own_chunks(lines, divisor, least):
    """The cutting rule once more: after a line of ``least`` words, before one, or where the mixed
    hashes of a line and the one before it are divisible."""
    mix, out, first = 0, [], 0
    big = [len(x.split()) >= least and len(x) > 2 * least - 2 for x in lines]
    for i, line in enumerate(lines):
        h = xxhash.xxh64(line).intdigest()
        rolled = (mix * 11400714819323198485 + h) % 2**64
        mix = h
        if i == len(lines) - 1 or big[i] or big[i + 1] or (rolled ^ rolled >> 29) % divisor == 0:
            if i > first or len(lines[first].split()) >= least:
                out.append((first, i + 1))
            first = i + 1
    return [(a, b) for a, b in out if b"\n".join(lines[a:b]).strip()]


def brute_lines(rows, divisor=4, least=50):
    """The lines that go, per row: repeated chunks by their bytes, and repeated runs of lines."""
    told = [(i, t) for i, t in rows if i is not None and t is not None]
    held = {}
    for i, t in told:
        lines = t.encode().split(b"\n")
        for a, b in own_chunks(lines, divisor, least):
            held.setdefault(b"\n".join(lines[a:b]), []).append(i)
    runs, out = brute_runs(told, least), []
    for i, t in rows:
        gone = set()
        if i is not None and t is not None:
            lines, seen = t.encode().split(b"\n"), set()
            gone = set(runs[i])
            for a, b in own_chunks(lines, divisor, least):
                chunk = b"\n".join(lines[a:b])
                if min(held[chunk]) < i or chunk in seen:
                    gone |= set(range(a, b))
                seen.add(chunk)
        out.append(gone)
    return out


def brute(rows):
    left = []
    for (i, t), gone in zip(rows, brute_lines(rows)):
        left.append((i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    return sorted(left, key=str)


def test_equals_brute_force_and_keeps_columns(docs):
    rng = random.Random(2)
    shared = [[f"line {k} {rng.random()}" for k in range(12)] for _ in range(4)] + [[" ".join(["long"] * 60) + str(k)] for k in range(2)]
    rows = []
    for i in range(40):
        lines = [f"own {rng.random()}" for _ in range(rng.randrange(6))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = rng.choice(shared)
        rows.append((i, "\n".join(lines)))
    rows += [(90, rows[3][1]), (91, rows[3][1] + "\n" + rows[3][1])] + EDGES
    df = docs(rows)
    found = dedup_lines(df)
    assert found.columns == [*df.columns, "n_lines", "removed"]
    got = found.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == brute(rows)
    assert any(r["removed"] for r in got) and {r["row"] for r in got} == {"r"}
    assert dedup_lines(docs([])).collect() == []


def test_cuts_do_not_shift(docs):
    rng = random.Random(8)
    block = [str(rng.random()).encode() for _ in range(60)]
    chunks = lambda lines: {tuple(lines[a:b]) for a, b in cut_lines(lines)}
    moved = chunks([b"new", b"lines", b"before"] + block + [b"after"])
    assert len(chunks(block) & moved) >= len(chunks(block)) - 2


def test_the_repeated_passage_goes_and_own_lines_stay(docs):
    passage = "\n".join(" ".join(f"p{k}w{j}" for j in range(55)) for k in range(2))
    rows = [(i, f"only {i}\n{passage}\nend {i}") for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs(rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"only {i}\nend {i}" for i in range(1, 5))


def brute_runs(rows, least):
    """Lines of all runs that begin and end with words, have ``least`` of them, and occur in a
    smaller id or earlier in the text without overlap. Each row's marked line numbers."""
    texts = [(i, t.split("\n")) for i, t in rows]
    times = Counter(x for _, lines in texts for x in lines)
    runs = {}
    for i, lines in texts:
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if times[lines[b - 1]] < 2:
                    break  # so is no run with this line
                if lines[a].strip() and lines[b - 1].strip() and sum(len(x.split()) for x in lines[a:b]) >= least:
                    runs.setdefault(tuple(lines[a:b]), []).append((i, a, b))
    gone = {i: set() for i, _ in texts}
    for places in runs.values():
        for i, a, b in places:
            if any(j < i or j == i and d <= a for j, _, d in places):
                gone[i] |= set(range(a, b))
    return gone


def test_passages_of_short_lines_go_whole(docs):
    rng = random.Random(5)
    line = lambda: " ".join(str(rng.random()) for _ in range(rng.randrange(1, 6)))
    shared = [[rng.choice([line(), line(), "", "x"]) for _ in range(rng.randrange(4, 14))] for _ in range(5)]
    rows = []
    for i in range(30):
        lines = [line() for _ in range(rng.randrange(6))]
        for _ in range(rng.randrange(3)):
            part, at = rng.choice(shared), rng.randrange(len(lines) + 1)
            lines[at:at] = part[rng.randrange(2) : len(part) - rng.randrange(2)]
        rows.append((i, "\n".join(lines)))
    rows += [(40, "\n".join(["y"] * 45)), (41, rows[4][1] + "\n" + rows[4][1] + "\n\n" + rows[7][1])]
    df = docs(rows)
    # No chunk is cut but the last, so that chunks alone find whole texts only.
    got = {r["doc_id"]: r for r in dedup_lines(df, divisor=1 << 40, long_words=12).collect()}
    of = lambda r: {k for x in r["removed"] for k in range(x["first"], x["end"])}
    runs = brute_runs(rows, 12)
    assert {i: of(r) for i, r in got.items()} == {i: gone for (i, _), gone in zip(rows, brute_lines(rows, 1 << 40, 12))}
    assert sum(map(len, runs.values())) > 100
    for i, t in rows:
        left = [x for k, x in enumerate(t.split("\n")) if k not in of(got[i])]
        assert got[i]["text"] == "\n".join(left)
        assert sum(x["end"] - x["first"] for x in got[i]["removed"]) == len(of(got[i]))


def test_the_query_takes_out_a_passage_of_four_lines(docs, monkeypatch):
    from fieldscan.llm import queries

    rows = []
    for k in range(12):
        passage = "\n".join(" ".join(f"k{k}p{n}w{j}" for j in range(15)) for n in range(4))
        rows += [(2 * k + m, f"before {k} {m}\n{passage}\nafter {k} {m}") for m in range(2)]
    monkeypatch.setattr(queries, "table", lambda *_: docs(rows))
    got = {r["doc_id"]: r["n_lines_removed"] for r in queries.op3_line_dedup(None, "").collect()}
    assert got == {i: 4 * (i % 2) for i in got} and len(got) == 24
