"""The pipeline's rows against a plain version of its five stages."""

import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tessera.llm import mixing, packing, quality_rules
from tests.llm.test_operators import SMALL, slow_best_fit, slow_fingerprint, slow_measures


def votes(text):
    """Each rule's vote on a text."""
    m = dict(zip(quality_rules.MEASURES, quality_rules.measure(text.encode()), strict=True))

    def share(a, b):
        return m[a] / max(1, m[b])

    def vote(x, good, bad):
        return -1 if bad(x) else 1 if good(x) else 0

    return (
        vote(share("word_chars", "n_words"), lambda x: 3 <= x <= 9, lambda x: x < 2 or x > 14),
        vote(share("n_symbols", "n_words"), lambda x: x <= 0.02, lambda x: x > 0.1),
        vote(share("n_dup_lines", "n_lines"), lambda x: x <= 0.05, lambda x: x > 0.3),
        vote(share("n_repeat_words", "n_words"), lambda x: x <= 0.05, lambda x: x > 0.15),
        vote(share("n_ended", "n_lines"), lambda x: x >= 0.7, lambda x: x < 0.3),
        vote(share("n_upper", "n_letters"), lambda x: x <= 0.15, lambda x: x > 0.4),
        vote(share("n_marks", "n_words"), lambda x: x <= 0.01, lambda x: x > 0.1),
        vote(share("n_bars", "n_words"), lambda x: x <= 0.01, lambda x: x > 0.1),
        vote(share("n_letters", "word_chars"), lambda x: x >= 0.85, lambda x: x < 0.7),
    )


def good_ones(docs):
    base = {}
    for d, (text, _) in docs.items():
        n, _, _, _, again = slow_measures(text)
        if n >= 10 and 100 * again <= 20 * n:
            base[d] = votes(text)
    counts = Counter(base.values())
    patterns = np.array([*counts])
    good, up, down, none = quality_rules.fit(patterns, np.array([*counts.values()], float))
    odds = np.log(good / (1 - good))
    kept = {p for p in counts if odds + sum(u if v == 1 else d if v == -1 else o for v, u, d, o in zip(p, up, down, none, strict=True)) >= 0}
    return {d: docs[d] for d, p in base.items() if p in kept}


def without_copies(docs):
    last = {}
    for d in sorted(docs):
        last[docs[d][0]] = d
    return {d: docs[d] for d in last.values()}


def without_near_copies(docs):
    prints = {d: slow_fingerprint(t) for d, (t, _) in docs.items()}
    least = {d: d for d in docs}
    moved = True
    while moved:
        moved = False
        for a in docs:
            for b in docs:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and least[a] > least[b]:
                    least[a], moved = least[b], True
    return {d: docs[d] for d in docs if least[d] == d}


def mixed(docs, draws):
    size, by = {d: len(t.split()) for d, (t, _) in docs.items()}, defaultdict(list)
    for d, (_, s) in docs.items():
        by[s].append(d)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {s: sum(size[d] for d in by[s]) for s in names}
    full = set()
    while True:
        level = (sum(total.values()) - 3 * sum(total[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weight[s] * level > 3 * total[s]}
        if not more:
            break
        full |= more
    times = {}
    for s in names:
        target = 3 * total[s] if s in full else weight[s] * level
        whole = int(target // total[s])
        rest = target - whole * total[s]
        for d in sorted(by[s], key=draws.get):
            times[d] = whole + (size[d] and rest * 2 >= size[d] and rest > 0)
            rest -= size[d] if rest > 0 else 0
    return Counter({d: int(n) for d, n in times.items() if n})


def test_rows_of_all_stages(spark):
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = {r.doc_id: (r.text or "", r.source) for r in table.collect()}
    plain = [good_ones, without_copies, without_near_copies]
    made, stages = table, corpus_pipeline.STAGES
    for (_, stage), slow in zip(stages[:3], plain, strict=True):
        made = stage(spark, made, SMALL).cache()
        docs = slow(docs)
        assert sorted(r.doc_id for r in made.select("doc_id").collect()) == sorted(docs)
        assert made.columns == table.columns
    assert len(docs) > 60
    draws = {r[0]: r[1] for r in made.select("doc_id", mixing.draw(made.doc_id.cast("string"), mixing.text_of("text"))).collect()}
    times = mixed(docs, draws)
    assert Counter(r.doc_id for r in stages[3][1](spark, made, SMALL).select("doc_id").collect()) == times
    got = corpus_pipeline.run(spark, SMALL).collect()
    tool, want = Tokenizer.from_file(packing.tokenizer_path(packing.VOCABULARY)), Counter()
    for d, n in times.items():
        ids = np.array([*tool.encode(docs[d][0], add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            cut = ids[k : k + 2048]
            want[d, k // 2048, k, len(cut), zlib.crc32(cut.tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        assert [s for s, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) <= 2048
    assert len(held) <= slow_best_fit([k[3] for k, n in want.items() for _ in range(n)], 2048) * 1.01 + 1


def test_run_leaves_only_its_result(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {*folder.iterdir()}
    corpus_pipeline.run(spark, SMALL)
    assert len({*folder.iterdir()} - before) == 1
