import random

import pytest
from pyspark.sql import functions as F

from veridant.llm.leakage import ItemIndex, find_leaks, words_of
from veridant.llm.packing import count_tokens, pack_containers, pack_sizes, packing_summary
from veridant.llm.splitting import coarsest_boundary, cut, split_texts, units
from veridant.llm.truncation import find_truncated, length_hazards, truncation_rates


def sentences(rng, n, vocabulary):
    return " ".join(" ".join(rng.choice(vocabulary) for _ in range(12)).capitalize() + "." for _ in range(n))


# --- 7


@pytest.mark.parametrize("seed", range(6))
def test_pieces_cover_the_text_and_overlap(seed):
    rng = random.Random(seed)
    topics = [[f"w{t}{i}" for i in range(40)] for t in range(4)]
    text = "\n\n".join(sentences(rng, rng.randrange(2, 9), t) for t in topics for _ in range(2))
    level, pieces = cut(text, 1000, 100)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= 1000 for a, b, _ in pieces)
    assert all(x[1] - y[0] == 100 for x, y in zip(pieces, pieces[1:], strict=False))
    if level != "none":
        ends = {x for u in units(text, level) for x in u}
        assert all(b in ends for _, b, _ in pieces[:-1])


def test_boundaries_and_hard_cuts():
    assert coarsest_boundary("a" * 10 + "\n\n" + "b" * 10, 10)[0] == "paragraph"
    assert coarsest_boundary("Aa bb. Cc dd.", 6)[0] == "sentence"
    assert coarsest_boundary("aa bb cc. dd", 4)[0] == "word"
    assert coarsest_boundary("a" * 11, 10)[0] == "none"
    assert cut("", 10, 2) == ("paragraph", [(0, 0, "end")])
    pieces = cut("x" * 5000, 2000, 200)[1]
    assert pieces[-1][1] == 5000 and all(b - a <= 2000 for a, b, _ in pieces)


def test_valley_is_cut_at_the_topic_change():
    rng = random.Random(1)
    a, b = [f"alpha{i}" for i in range(20)], [f"beta{i}" for i in range(20)]
    text = sentences(rng, 9, a) + " " + sentences(rng, 9, b)
    change = text.lower().index("beta")
    _, pieces = cut(text, 1400, 100)
    assert abs(pieces[0][1] - change) < 20


def test_split_texts_edges(spark):
    df = spark.createDataFrame([("a", None, "s", 1), ("b", "", "s", None), ("c", "Hello there.", None, 7), ("c", "Hello there.", None, 7)], "id string, text string, sec string, at int")
    got = sorted((r.span_id, r.piece_count, r.piece_end, r.document_start) for r in split_texts(df, "id", "text", "sec", "at").collect())
    assert got == [("b", 1, 0, None), ("c", 1, 12, 7), ("c", 1, 12, 7)]


def test_a_long_sentence_or_word_leaves_other_cuts_at_coarser_ends():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(80)]
    prose = "\n\n".join(sentences(rng, 4, vocabulary) for _ in range(12))
    for long in (" ".join(rng.choice(vocabulary) for _ in range(400)), "x" * 1500):
        text = prose + "\n\n" + long + ". " + sentences(rng, 4, vocabulary) + "\n\n" + prose
        ends = {x for u in units(text, "paragraph") for x in u}
        a, b = text.index(long), text.index(long) + len(long)
        level, pieces = cut(text, 1000, 100)
        assert level == ("word" if " " in long else "none")
        outside = [(end, kind) for _, end, kind in pieces[:-1] if not a - 1000 < end < b + 1000]
        assert outside and all(end in ends and kind == "paragraph" for end, kind in outside)
        assert {kind for _, end, kind in pieces if a < end < b} == {"word" if " " in long else "none"}


# --- 8


@pytest.mark.parametrize("seed", range(4))
def test_packing_places_every_item_once(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 60), rng.randrange(1, 2049)]) for _ in range(3000)]
    packed = pack_sizes(sizes, (512, 1024, 2048))
    assert sorted(i for _, items in packed for i in items) == list(range(3000))
    assert all(sum(sizes[i] for i in items) <= c for c, items in packed)
    # first-fit decreasing by brute force needs as many full containers, give or take
    assert sum(c for c, _ in packed) <= sum(sizes) * 1.01 + 2048


def test_packing_small_cases(spark):
    assert pack_sizes([], (10,)) == []
    df = spark.createDataFrame([(1, 5000), (2, 96), (3, 0), (4, None), (5, 2048)], "id int, n int")
    got = pack_containers(df, "id", "n").collect()
    assert sorted((r.id, r.part, r.part_size) for r in got) == [(1, 0, 2048), (1, 1, 2048), (1, 2, 904), (2, 0, 96), (5, 0, 2048)]
    assert all(r.capacity == 2048 for r in got if r.part_size == 2048)
    assert packing_summary(pack_containers(df.limit(0), "id", "n")).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "id int, text string")
    got = {r.id: r.n_tokens for r in count_tokens(df, "id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[4] > 1


# --- 9


def brute(items, text, run):
    ws = words_of(text)
    runs = {tuple(ws[i : i + run]) for i in range(len(ws) - run + 1)}
    return sorted(i for i, t in items if any(tuple(words_of(t)[k : k + run]) in runs for k in range(len(words_of(t)) - run + 1)))


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(40)]
    texts = []
    for i in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 400))]
        if i % 3 == 0:
            ws = items[rng.randrange(40)][1].split()
            n, at = rng.choice([11, 12, 13, 30]), rng.randrange(0, 10)
            p = rng.randrange(len(body))
            body[p:p] = [w.upper() + "," for w in ws[at : at + n]]
        texts.append((i, " ".join(body)))
    texts += [(900, None), (901, ""), (0, texts[0][1])]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    it = spark.createDataFrame([*items, (77, None), (78, ""), (79, "too short")], "item_id int, text string")
    want = sorted((d, i) for d, t in dict(texts).items() if t for i in brute(items, t, 12))
    assert want
    for limit in (64 << 20, 2000):
        assert sorted((r.doc_id, r.item_id) for r in find_leaks(df, "doc_id", "text", it, "item_id", "text", index_limit=limit).collect()) == want
    assert find_leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_wand_returns_all_items_over_their_threshold():
    rng = random.Random(4)
    ix = ItemIndex([(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(30))) for i in range(200)], 5)
    for _ in range(50):
        query = sorted(rng.sample(range(len(ix.term)), 8))
        want = [d for d in range(200) if sum(x for t in query for e, x in zip(ix.docs[t], ix.impacts[t], strict=True) if e == d) >= ix.threshold[d]]
        assert sorted(ix.retrieve(query)) == want


# --- 10


def test_endings(spark):
    closed = ["It ended well.", "A headline without a stop", "Sales rose. (unaudited)", 'He said so. "We will see..."', "Text here.\n\n/s/ Maren Oldt", "Text here.\n\nPage 3 of 9", "Rows:\n| a | b |\n|---|---|\n| x | 1 |", "All of it in fiscal 2019."]
    open_ = ["One sentence. Then the text stops in the mid", "Sentence one. Sent [...]", "Sentence one. Sent…", "Rows:\n| a | b |\n|---|---|\n| x |", 'He said. "We are not," the chief executive']
    rows = [(t, "s") for t in closed + open_] + [(None, "s"), ("", None), ("   ", "s")]
    got = {r.text: (r.ending, r.truncated) for r in find_truncated(spark.createDataFrame(rows, "text string, source string"), "text", "source").collect()}
    assert [t for t in closed if got[t][1]] == []
    assert [t for t in open_ if not got[t][1]] == []
    assert all(got[t] == ("none", False) for t in (None, "", "   "))


def test_unclear_endings_are_cut_at_significant_lengths_only(spark):
    rng = random.Random(7)
    limit = [("Prices rose again. " + "x" * (470 + k % 1) + " to 12.", "a") for k in range(60)]
    spread = [("Prices rose again. " + "x" * rng.randrange(50, 900) + " to 12.", "a") for _ in range(600)]
    other = [("Prices rose again. " + "x" * 470 + " to 12.", "b")]
    found = find_truncated(spark.createDataFrame(limit + spread + other, "text string, source string"), "text", "source")
    n = len(limit[0][0])
    assert found.filter(F.col("source") == "b").filter("truncated").count() == 0
    at = found.filter((F.col("source") == "a") & (F.length("text") == n))
    assert at.filter("NOT truncated").count() == 0
    rates = {r.source: r for r in truncation_rates(found, "source").collect()}
    assert rates["b"].cut_texts == 0 and 60 <= rates["a"].cut_texts < 200


def test_hazards_find_a_limit_and_not_a_smooth_tail(spark):
    rng = random.Random(9)
    lengths = [("a", min(int(rng.expovariate(1 / 400)), 1000)) for _ in range(4000)] + [("b", int(rng.expovariate(1 / 400))) for _ in range(4000)] + [(None, 5), ("a", None)]
    got = length_hazards(spark.createDataFrame(lengths, "source string, n int"), "source", "n").filter("significant").collect()
    assert {(r.source, r.block) for r in got if r.width == 1} == {("a", 1000)}
    assert not [r for r in got if r.source == "b"]


@pytest.mark.parametrize("times", [1, 12])
def test_cut_decimals_are_found_in_corpora_of_any_size(spark, times):
    rng = random.Random(11)
    rows = [(f"Sales of ${rng.randrange(1, 99)}.{rng.randrange(1, 99)} were noted on day {k}. Margin was 4.{k}. It rose.", "s") for k in range(40 * times)]
    cut_ = [("Lead. " + "x" * rng.randrange(50, 900) + f" {k} with revenue of ${rng.randrange(1, 99)}.", "s") for k in range(3 * times)]
    whole = [("Lead. " + "x" * rng.randrange(50, 900) + f" {k} margin was 4.{k}.", "s") for k in range(3 * times)]
    rare = [("Lead. " + "y" * 77 + " which totalled $8.", "s")]
    found = find_truncated(spark.createDataFrame(rows + cut_ + whole + rare, "text string, source string"), "text", "source")
    assert {r.text for r in found.filter("ending = 'open'").collect()} == {t for t, _ in cut_ + rare}
    assert {r.text for r in found.filter("ending = 'closed'").collect()} == {t for t, _ in rows + whole}


def test_a_list_item_cut_at_a_limit_is_no_closing_line_however_often_it_recurs(spark):
    rng = random.Random(13)
    body = lambda n: "Lead. " + "".join(rng.choice("abcdefgh") for _ in range(n)) + ".\n"
    whole, fragment, title = "- Reconciliation of adjusted earnings", "- Reconciliation of adj", "/s/ Maren Oldt, Chief Accounting Officer"
    rows = [(body(rng.randrange(50, 1500)) + x, "a") for x in (whole, title) for _ in range(150)] + [(body(rng.randrange(50, 1500)) + "It ended.", "a") for _ in range(300)]
    cut_ = [(body(700) + fragment, "a") for _ in range(40)] + [(body(700) + "- Copied fragm", "a")] * 30
    found = find_truncated(spark.createDataFrame(rows + cut_, "text string, source string"), "text", "source")
    assert {r.text for r in found.filter("truncated").collect()} == {t for t, _ in cut_}
    assert {r.ending for r in found.filter(F.col("text").endswith(whole) | F.col("text").endswith(title)).collect()} == {"closed"}


def test_long_closing_lines_are_cut_at_significant_lengths_only(spark):
    rng = random.Random(17)
    line = lambda n: "It ended.\nSource: " + "".join(rng.choice("abcdefgh ") for _ in range(n)) + "z"
    free, limit = [(line(n), "a") for n in range(450, 2500, 41)], [(line(1200), "b") for _ in range(60)]
    other = [("Lead. " + "x" * rng.randrange(50, 2500) + ".", "b") for _ in range(400)]
    found = find_truncated(spark.createDataFrame(free + limit + other, "text string, source string"), "text", "source")
    assert {r.text for r in found.filter("truncated").collect()} == {t for t, _ in limit}


def test_wand_decides_the_rows_and_skips_blocks(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(50))) for i in range(300)]
    ix = ItemIndex(items, 12)
    place = {i: d for d, i in enumerate(ix.ids)}
    held = sum(map(len, ix.docs))
    touched = 0
    for i, t in items[:60]:
        ws = t.split()
        before = ix.scored
        query = sorted({ix.term[w] for w in ws[10:34]})
        assert place[i] in ix.retrieve(query)
        touched += ix.scored - before
        every = sum(len(ix.docs[q]) for q in query)
        assert ix.scored - before < every
    # most postings of the query terms are passed over by block
    assert touched < 0.5 * sum(sum(len(ix.docs[q]) for q in {ix.term[w] for w in t.split()[10:34]}) for _, t in items[:60]) and held
    text = "before " + items[5][1] + " after"
    assert {x[0] for x in ix.leaks(text, 48)} == {5}
    monkeypatch.setattr(ItemIndex, "retrieve", lambda self, terms: [])
    assert ix.leaks(text, 48) == []


def test_overlap_of_question_and_answer():
    item = "How many lanterns did the harbour guild of Ostmark order in that spring? Answer: forty two brass lanterns with green glass panes and iron hooks for the long pier"
    ix = ItemIndex([(1, item)], 12)
    question = item.split("Answer:")[0]
    (_, _, run, q, a) = ix.leaks("It was asked: " + question, 96)[0]
    assert run == 13 and q == 1.0 and a < 0.5
    (_, _, run, q, a) = ix.leaks("forty two brass lanterns with green glass panes and iron hooks for the long pier", 96)[0]
    assert a == 1.0 and q < 1.0
    (_, _, _, q, a) = ItemIndex([(1, question)], 12).leaks(question, 96)[0]
    assert q == 1.0 and a is None
    assert ix.leaks("", 96) == [] and ix.leaks("forty two brass", 96) == []


def test_best_fit_leaves_less_than_first_fit_and_opens_fitting_sizes():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 2049) for _ in range(4000)]
    packed = pack_sizes(sizes, (256, 512, 1024, 2048))
    assert sorted(i for _, b in packed for i in b) == list(range(4000))
    assert all(sum(sizes[i] for i in b) <= c for c, b in packed)
    assert sum(sizes) / sum(c for c, _ in packed) > 0.97
    # an item goes where it leaves the least room: 60 joins 40, not 30
    assert sorted(sorted(sizes) for sizes in ([[70, 40, 30, 60][i] for i in b] for _, b in pack_sizes([70, 40, 30, 60], (100,)))) == [[30, 70], [40, 60]]
    assert [c for c, _ in pack_sizes([250], (256, 512))] == [256]


def test_endings_off_limits_count_by_the_shapes_of_cuts(spark):
    rng = random.Random(11)
    rows = [("x" * 40 + ". Word " * 8 + "and " + "".join(rng.choice("abcdef") for _ in range(296)), "a") for _ in range(80)]
    rows = [(t[:300], s) for t, s in rows]
    rows += [("S" * rng.randrange(40, 900) + " is one. It closed here.", "a") for _ in range(400)]
    # endings with a colon are common off limits and never at them: no shape of cuts
    rows += [("S" * rng.randrange(400, 900) + " is one. The list is as follows:", "a") for _ in range(200)]
    rows += [("Sentence one is here. Then it sto", "b")]
    got = find_truncated(spark.createDataFrame(rows, "text string, source string"), "text", "source").collect()
    by = {}
    for r in got:
        kind = "lone" if r.source == "b" else "colon" if r.text.endswith(":") else "closed" if r.text.endswith(".") else "limit"
        by.setdefault(kind, set()).add((r.evidence, r.truncated))
    assert by == {"limit": {("length", True)}, "closed": {(None, False)}, "colon": {(None, False)}, "lone": {("ending", True)}}
