import random
import re

from lexiloom.llm import common, decontaminate


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(docs, items):
    out = set()
    for d, text in docs:
        own = grams(text)
        for i, item in items:
            want = grams(item)
            if want and len(own & want) >= 0.8 * len(want):
                out.add((d, i, len(want), len(own & want)))
    return out


def run(spark, docs, items):
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return [(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect()]


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "Über", "x-1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 4, 5, 6, 9, 20, 45, 70]))) for i in range(40)] + [(90, ""), (91, None)]
    docs = [(i, say(rng.randint(0, 50))) for i in range(60)]
    for i in range(200):
        words = rng.choice(items[:40])[1].split()
        for _ in range(rng.randint(0, 3)):  # edits, up to and beyond the least share
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        cut = rng.randint(0, len(words))  # not always in one piece
        docs.append((100 + i, f"{say(rng.randint(0, 300))}. {' '.join(words[:cut]).upper()} {say(rng.randint(0, 2))} {' '.join(words[cut:])}! {say(rng.randint(0, 60))}"))
    docs += [(900, None), (901, ""), (902, items[6][1]), (902, items[6][1]), (None, items[6][1])]
    got, want = run(spark, docs, items), brute(docs, items)
    assert len(want) > 25 and len(got) == len(set(got)) and set(got) == want


def test_without_broadcast_and_empty(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    item = "one two three four five six seven"
    assert run(spark, [(1, f"x {item} y"), (2, "clean text of no item at all")], [(7, item)]) == [(1, 7, 3, 3)]
    assert run(spark, [], [(7, item)]) == [] and run(spark, [(1, item)], []) == []
    docs = spark.createDataFrame([(1, f"x {item}", "a", 1), (2, "clean", "b", 2), (None, None, "c", 3)], "doc_id long, text string, items string, hash int")
    left = decontaminate.clean(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r["hash"] for r in left.collect()) == [2, 3]


def test_clean_tells_rows_apart(spark):
    """A contaminated row takes no clean one with it, be it without an id or under the same one."""
    item = "one two three four five six seven"
    rows = [(None, f"x {item}", 1), (None, "clean text of no item", 2), (None, None, 3), (5, f"{item} y", 4), (5, "clean too", 5)]
    left = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string, row int"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(r.row for r in left.collect()) == [2, 3, 5]
