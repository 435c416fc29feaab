"""Near duplicates against brute force over all pairs."""

import random
import re

from blendscope.llm import neardup
from blendscope.llm.graph import components


def brute_force(rows):
    """component by doc_id: links at 75 % of exact shingle sets, smallest reachable id."""
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[doc] = {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
    label = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label, {d: len(s) for d, s in sets.items()}


def compare(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    label, sizes = brute_force([r for r in rows if r[0] is not None])
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (label[r.doc_id], sizes[r.doc_id], label[r.doc_id] == r.doc_id)


def test_chains_groups_and_shared_passages(frame):
    rng = random.Random(5)
    def words(n):
        return ["w%d" % rng.randrange(100_000) for _ in range(n)]
    def changed(text, n):
        text = list(text)
        for _ in range(n):
            text[rng.randrange(len(text))] = "c%d" % rng.randrange(100_000)
        return text
    docs = [words(rng.randint(1, 80)) for _ in range(150)]
    passage = words(60)
    docs += [passage + words(60) for _ in range(60)]  # half shared: no links
    base = words(120)
    docs += [changed(base, rng.randint(0, 6)) for _ in range(120)]  # similar to the base, not always to each other
    chain = words(200)
    for _ in range(12):
        docs.append(chain)
        chain = changed(chain, 4)
    docs += [base] * 40
    rng.shuffle(docs)
    compare(frame([(i * 3, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string").repartition(5))


def test_pairs_on_one_template_whose_members_were_never_a_centre(frame):
    rng = random.Random(8)
    def words(n):
        return ["w%d" % rng.randrange(1 << 40) for _ in range(n)]
    template = words(204)
    docs = [template + words(36) for _ in range(1000)]  # 200 of 272 shingles in common: no links
    label = {i: i for i in range(1000)}
    for i in range(40):  # 203 of 269: linked
        docs.append(template + docs[i][204:207] + words(33))
        label[1000 + i] = i
    got = neardup.near_duplicates(frame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string").repartition(5))
    assert {r.doc_id: r.component_id for r in got.collect()} == label


def test_hard_rows(hard_docs):
    compare(hard_docs)


def test_short_sets(frame):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, "A B c d e f g H"), (4, "a b c"), (5, "a b  c"), (6, "a b c d"), (7, "d")]
    compare(frame(rows, "doc_id bigint, text string"))


def test_empty_table_and_no_links(frame):
    assert neardup.near_duplicates(frame([], "doc_id bigint, text string")).count() == 0
    compare(frame([(1, "nothing alike here at all"), (2, "something else is written there")], "doc_id bigint, text string"))


def test_hot_sets_and_missing_ids_are_labelled_like_others(frame):
    sets = {b"hot": 300, b"warm": 9, b"one": 1}
    rows, named, at = [], [], 0
    for set_id, times in sets.items():
        rows += [(at + i, 3, set_id) for i in range(times)]
        named.append((set_id, times, at))
        at += times
    rows += [(at, 0, None), (None, 3, b"hot"), (None, 0, None)]
    got = neardup.labelled(frame(rows, "doc_id bigint, n_shingles bigint, set_id binary"),
                           frame(named, "set_id binary, times bigint, component_id bigint"), hot_share=10).collect()
    label = {set_id: first for set_id, _, first in named}
    want = {(d, n, None if d is None else label.get(s, d), d is None or label.get(s, d) == d) for d, n, s in rows}
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_deduplicate_keeps_one_row_of_a_document(hard_docs):
    got = neardup.deduplicate(hard_docs)
    assert got.columns == hard_docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 7, 8] and ids.count(None) == 2


def test_components_of_a_long_path(frame):
    n = 60
    links = frame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}
