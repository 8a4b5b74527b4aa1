"""Templates: exact copies, new numbers, names and units, and what is not a leak."""

import pytest

from askgrid.llm import decontamination

ITEM = "Alice Smith buys 12 apples for 3 dollars each and later Alice Smith sells half of the apples to Bob Jones for 5 dollars"


@pytest.fixture
def benchmark(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id LONG, text STRING").selectExpr("*", "'x' as hash", "1 as start")

    return make


def found(docs, benchmark, **options):
    return {(r["doc_id"], r["item_id"]): r["n_changed"] for r in decontamination.find_leaks(docs, benchmark, **options).collect()}


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_WINDOWS, 0])
def test_leaks(documents, benchmark, prose, limit):
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "40").replace("3", "7")
    mixed = ITEM.replace("Alice Smith buys", "Carol Smith buys").replace("later Alice", "later Erin")
    rows = [
        (1, f"{prose(1, 30)} {ITEM} {prose(2, 30)}"),
        (2, f"{prose(3, 30)} {other}. {prose(4, 300)}"),
        (3, ITEM.upper()),
        (4, " ".join(ITEM.split()[:7]) + " " + prose(5, 40)),  # less than a window
        (5, prose(6, 400)),
        (6, None), (7, ""), (8, "| * |"), (None, f"x {ITEM}"),
        (9, f"{ITEM} {prose(7, 9)} {ITEM}"), (9, f"{ITEM} {prose(7, 9)} {ITEM}"),
        (10, "Alice 3 Bob 5 Carol 7 Dave 9 Erin 11 Fay 13 " * 3),  # nothing but slots
        (11, prose(8, 20000) + " " + ITEM),
        (12, mixed),
    ]
    items = [(1, ITEM), (1, ITEM), (2, prose(9, 5)), (3, None), (4, ""), (5, "too short")]
    got = found(documents(rows), benchmark(items), broadcast_windows=limit)
    assert set(got) == {(i, 1) for i in (1, 2, 3, 9, 11, None, 12)} - {(12, 1)} | ({(12, 1)} & set(got))
    assert got[1, 1] == 0 and got[3, 1] == 0 and got[2, 1] >= 4


def test_inconsistent_slots_are_no_leak(documents, benchmark):
    item = "so Ann gives some of her many coins to Ben and Ann takes back some of them"
    same = item.replace("Ann", "Eve").replace("Ben", "Tom")
    crossed = "so Eve gives some of her many coins to Eve and Tom takes back some of them"
    assert set(found(documents([(1, same), (2, crossed)]), benchmark([(1, item)]))) == {(1, 1)}


def test_short_items_need_all_their_words(documents, benchmark):
    rows = [(1, "see what is the largest planet here"), (2, "what is the largest of them")]
    assert set(found(documents(rows), benchmark([(1, "what is the largest planet")]))) == {(1, 1)}


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_WINDOWS, 0])
def test_windows_of_few_plain_words_short_items_and_scripts_without_blanks(documents, benchmark, prose, limit):
    sum_, long = "What is 12 * 7 + 5 - 3 ?", "".join(chr(0x4E00 + 37 * i % 5000) for i in range(60))
    items = [(1, sum_), (2, "1 km 2 m 3 cm 4 mm 5 kg"), (3, "capital of France"), (4, "日本の首都は？"), (5, long), (6, "12 * 7")]
    rows = [
        (1, f"{prose(1, 30)} {sum_.upper()} {prose(2, 30)}"),
        (2, "what is 12 + 7 * 5 - 3"), (3, "what is 12 * 7 + 5 - 4"),
        (4, f"{prose(3, 9)} 1 km 2 m 3 cm 4 mm, 5 kg."),
        (5, "the Capital of France, and the capital of france"), (6, "capital of Spain"), (7, "capital often France"),
        (8, "問題。日本の首都は東京"), (9, "日本の首相は"), (10, f"文{long[20:50]}字"), (11, long[20:40]), (12, "12 7"),
    ]
    got = found(documents(rows), benchmark(items), broadcast_windows=limit)
    assert set(got) == {(1, 1), (1, 6), (3, 6), (4, 2), (5, 3), (8, 4), (10, 5)} and set(got.values()) == {0}


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_WINDOWS, 0])
def test_phrases_of_many_items_find_none(documents, benchmark, prose, limit):
    phrase = "please read the following question and answer it with"
    items = [(i, f"{phrase} {prose(i, 12)}") for i in range(40)]
    # Words of their own, so that no document goes on after the phrase as an item does.
    other = lambda seed: " ".join(f"z{w}" for w in prose(seed, 20).split())
    rows = [(i, f"{other(100 + i)} {phrase} {other(200 + i)}") for i in range(40)]
    rows += [(100, items[3][1]), (101, " ".join(items[5][1].split()[7:]))]
    assert set(found(documents(rows), benchmark(items), broadcast_windows=limit)) == {(100, 3), (101, 5)}


def test_items_of_shared_windows_alone_are_found_as_a_whole(documents, benchmark, prose):
    words = prose(1, 30).split()
    items = [(i, " ".join(words[i : i + 14])) for i in range(12)]  # windows of one item are those of others
    rows = [(1, f"x {items[6][1]} y"), (2, " ".join(words[8:18]))]
    assert set(found(documents(rows), benchmark(items), own_items=1)) == {(1, 6)}
    assert (2, 6) in found(documents(rows), benchmark(items), own_items=20)


def test_items_that_differ_in_slots_are_one_kind(documents, benchmark):
    items = [(i, f"so Ann gives {i + 2} of her many coins to Ben and goes on her way") for i in range(20)]
    got = found(documents([(1, items[4][1])]), benchmark(items))
    assert set(got) == {(1, i) for i in range(20)} and got[1, 4] == 0


def test_empty_tables(documents, benchmark):
    assert found(documents([]), benchmark([(1, ITEM)])) == {}
    assert found(documents([(1, ITEM)]), benchmark([])) == {}


def test_templates():
    two = decontamination.both_templates
    assert two("Bob,") == ("<name>", "bob") and two("the") == ("the", "the") and two("|") == ("", "")
    assert two("12,000") == two("1/2") == two("two") == ("<number>", "<number>")
    assert two("$5") == two("5km") == two("3.5%") == ("<number><unit>",) * 2
    assert two("km") == ("<unit>", "<unit>") and two("x2") == ("x2", "x2")


def test_query(spark):
    """Every item that stands in a document word for word is found, and nothing without eight of its words."""
    folder = "/root/testdata/sf0.01"
    grams = {}
    for row in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        words = row["text"].lower().split()
        for i in range(len(words) - 7):
            grams.setdefault(tuple(words[i : i + 8]), set()).add(row["item_id"])
    expected = set()
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words = row["text"].lower().split()
        for i in range(len(words) - 7):
            expected |= {(row["doc_id"], j) for j in grams.get(tuple(words[i : i + 8]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.op8_decontamination(spark, folder).collect()}
    assert got == expected and got


def test_a_plain_word_is_hashed_once_and_equals_its_templates(monkeypatch):
    import random

    import xxhash

    chosen = random.Random(5)
    letters = "abzABZkKmMß日本ΣςİıÉñ0129.,;%$€°/-+'\"(<|*#・"
    words = ["".join(chosen.choices(letters, k=chosen.randint(1, 5))) for _ in range(3000)]
    words += [w for x in ("kg", "three", "Celsius", "m", "%") for w in (x, x.upper(), f"({x})", f"3{x}", f"${x}")]
    digest, met = xxhash.xxh3_64_intdigest, []
    known = decontamination._Templates()
    places = known.of(words)
    for word, place in zip(words, places.tolist(), strict=True):
        one, other = decontamination.both_templates(word)
        shapes = (one, other, decontamination.exact_word(word))
        assert known.hashes[place].tolist() == [digest(x) if x else 0 for x in shapes]
        folded = decontamination.both_templates(word.lower())[1]
        assert [int(known.literal[place]) >> bit & 1 for bit in range(3)] == [x[:1] != "<" for x in (one, other, folded)]
    monkeypatch.setattr(decontamination.xxhash, "xxh3_64_intdigest", lambda x: met.append(x) or digest(x))
    decontamination._Templates().of(["some", "plain", "Words,", "stand", "here."])
    assert len(met) == 5
