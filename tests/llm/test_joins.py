"""Decontamination, URL rules, sharding and the n-gram join: against brute force on small tables."""

import random
import re
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from strataseek.llm import common, components, decontaminate, ngram_join, queries, sharding, url_rules
from strataseek.llm.common import portions
from tests.conftest import rows_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        item = [bytes([c]) for c in rng.choices(b"abc", k=rng.randint(1, 9))]
        region = [bytes([c]) for c in rng.choices(b"abc", k=rng.randint(0, 12))]
        best = min(distance(item, region[i:j]) for i in range(len(region) + 1) for j in range(i, len(region) + 1))
        got, end = decontaminate.edit_distance_within(item, region)
        assert got == best
        assert min(distance(item, region[i:end]) for i in range(end + 1)) == best


def edited(rng, words, vocab, n):
    words = list(words)
    for _ in range(n):
        p = rng.randrange(len(words))
        match rng.randrange(3):
            case 0:
                words[p] = rng.choice(vocab)
            case 1:
                words.insert(p, rng.choice(vocab))
            case 2:
                words.pop(p)
    return words


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(9)
    vocab = ["w" + "".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    return rng, vocab, [rng.choices(vocab, k=rng.randint(10, 60)) for _ in range(150)]


@pytest.mark.parametrize("share", [0, 0.1, 0.2])
def test_edited_passages_are_found(passages, share):
    rng, vocab, items = passages
    index = decontaminate.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    texts = [" ".join([*rng.choices(vocab, k=70), *edited(rng, w, vocab, int(share * len(w) + 1e-9)), *rng.choices(vocab, k=40)]) for w in items]
    found = index.search(texts)
    assert sum(any(h[0] == i for h in hits) for i, hits in enumerate(found)) >= 0.95 * len(items)
    for i, hits in enumerate(found):
        for item, d, first, n, similarity in hits:
            run = decontaminate.words_of(texts[i])[first : first + n]
            target = decontaminate.words_of(" ".join(items[item]))
            assert distance(target, run) == d <= decontaminate.allowed(len(target)) and similarity >= 0.8 - 1e-9


def test_clean_texts_are_left_alone(passages):
    rng, vocab, items = passages
    index = decontaminate.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    texts = [" ".join(rng.choices(vocab, k=200)) for _ in range(200)] + [" ".join(w[: len(w) // 2]) for w in items]
    assert not any(index.search(texts))


def test_decontamination_tables(spark, awkward, passages):
    _, _, items = passages
    bench = spark.createDataFrame([(1, " ".join(items[0])), (2, "plain text with some words in it plain text"), (3, None), (None, " ".join(items[1])), (2, "")], "item_id long, text string")
    with_leak = awkward.unionByName(spark.createDataFrame([(90, "x " + ", ".join(items[0]).upper() + " y"), (91, " ".join(items[1]))], "doc_id long, text string"), allowMissingColumns=True)
    rows = decontaminate.matches(with_leak, bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in rows) == Counter({(1, 2): 2, (90, 1): 1, (91, None): 1})
    split = decontaminate.matches(with_leak, bench, max_bytes=200).collect()
    assert Counter(map(tuple, split)) == Counter(map(tuple, rows))
    clean = decontaminate.keep_clean(with_leak, bench, max_bytes=200)
    assert clean.columns == with_leak.columns and clean.count() == with_leak.count() - 4
    assert decontaminate.matches(awkward.limit(0), bench).isEmpty()
    assert decontaminate.matches(awkward, bench.limit(0)).isEmpty() and decontaminate.keep_clean(awkward, bench.limit(0)).count() == awkward.count()


def test_benchmark_passages_in_documents(spark, sf):
    """Recall on the given tables: every document that holds an item as it stands is found."""
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    held = {(r["doc_id"], i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, t in bench.items() if t in (r["text"] or "")}
    assert held and held <= {(r["doc_id"], r["item_id"]) for r in queries.op2_decontamination(spark, sf).collect()}


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com", "http://a.example.com/en/x?y#z", "http://www.example.com/en/q", "http://www.example.com/en", "x://net/fr/", "x://a.net/es/b://c/",
    "http://xnet/es/", "http://example.comx/en/", "http://com/", "http://.com/", "a://b://com/en/", "http://example.com?en/", "http://w.www.example.com/en/#/", "http://a..net/fr/\n", "http://É.net/fr/é",
]


def brute_rule(host, path):
    fits = [r for r in queries.URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0]) + len(r[1]), default=None)


@pytest.mark.parametrize("max_rules", [100, 0])
def test_url_rules(spark, max_rules):
    rng = random.Random(1)
    urls = URLS + ["http://" + ".".join(rng.choices(["www", "example", "com", "net", "a", "m"], k=rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/es/x", "/fr/", "/en", "?q", "#/en/"]) for _ in range(400)] + ["http://www.example.com/en/same"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    rows = url_rules.judge(pages, rules, max_rules=max_rules).collect()
    assert sorted(r["page_id"] for r in rows) == list(range(len(urls)))
    for r in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", urls[r["page_id"]] or "")
        host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")
        rule = brute_rule(host, path)
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == ((rule[0] + rule[1], rule[2]) if rule else (None, "allow")), urls[r["page_id"]]


def test_url_query(spark, duck, sf):
    assert rows_of(queries.op5_url_filters(spark, sf).toPandas()) == rows_of(duck.execute(queries.oracle_sql()["op5_url_filters"]).df())


def test_no_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(r["rule"], r["verdict"]) for r in url_rules.judge(pages, rules).collect()} == {(None, "allow")}
    assert url_rules.judge(pages.limit(0), rules, max_rules=-1).isEmpty()


def check_shards(rows, shards, miss):
    total = Counter()
    slots = defaultdict(set)
    for r in rows:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].add(r["slot"])
    n = Counter(r["shard"] for r in rows)
    assert all(slots[s] == set(range(n[s])) for s in n)
    assert max(total.values()) - min(total[s] for s in range(shards)) <= miss * sum(total.values()) / shards
    groups = defaultdict(set)
    for r in rows:
        groups[r["text_crc32"]].add(r["shard"])
    return sum(len(g) > 1 for g in groups.values())


def test_sharding(spark, sf):
    documents = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = sharding.shard(documents).collect()
    assert len(rows) == documents.count() and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert check_shards(rows, 8, 0.02) == 0
    import zlib

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)


@pytest.mark.parametrize("sent", [500_000, 0])
def test_equal_texts_of_several_languages(spark, monkeypatch, sent):
    """A text that stands in the table once in each language goes to one shard, and the bytes stay even."""
    monkeypatch.setattr(sharding, "SENT", sent)
    rows = [(400 * k + i, f"text {i} " * (5 + i % 40), lang) for i in range(400) for k, lang in enumerate(("en", "de", "fr", None))]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 8).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["doc_id"] % 400, set()).add(r["shard"])
    assert len(out) == 1600 and all(len(g) == 1 for g in groups.values())
    sizes = [sum(r["size"] for r in out if r["shard"] == k) for k in range(8)]
    assert max(sizes) - min(sizes) < 0.06 * sum(sizes) / 8


def test_portions():
    """Slices are bounded by rows and by bytes of texts; a text beyond the bound comes alone; nothing is lost."""
    texts = ["a" * n for n in (3, 0, 10, 4, 4, 1, 50, 2)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    cut = [p.column(1).to_pylist() for p in portions(batch, 3, 10)]
    assert sum(cut, []) == texts and all(len(c) <= 3 and (len(c) == 1 or sum(len(t or "") for t in c) <= 10) for c in cut)
    assert list(portions(batch.slice(0, 0), 3, 10)) == [] and [p.num_rows for p in portions(batch.slice(6), 99, 1 << 60)] == [4]


def test_a_group_too_large_for_a_shard(spark):
    rows = [(i, "copy " * 50, "en") for i in range(600)] + [(1000 + i, f"text {i} " * 40, "de") for i in range(900)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5).collect()
    assert check_shards(found, 5, 0.05) == 1


def test_shard_tables(spark, awkward):
    assert len(sharding.shard(awkward).collect()) == awkward.count()
    assert sharding.shard(awkward.limit(0)).isEmpty()
    small = sharding.shard(awkward.drop("lang"), target_bytes=100).collect()
    check_shards(small, max(r["shard"] for r in small) + 1, 1e9)
    assert {r["shard"] for r in sharding.shard(awkward, 1).collect()} == {0}


def brute_join(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[i : i + 3]) for i in range(len(w) - 2)])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(seed, groups, members):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    out, n = [], 0
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.choice([3, 9, 11, 12, 20, 40, 90, 150]))
        for _ in range(rng.randint(1, members)):
            words = edited(rng, base, vocab, rng.choice([0, 0, 1, 1, 2, 3]) if len(base) > 5 else 0)
            text = " ".join(words)
            out.append((n, text.upper() if rng.random() < 0.2 else text))
            n += 1
            if rng.random() < 0.3:
                base = words  # copies of copies
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rows_a_block, columns", [(256, 4096), (4, 16)])
def test_join(spark, monkeypatch, rows_a_block, columns):
    monkeypatch.setattr(ngram_join, "ROWS", rows_a_block)
    monkeypatch.setattr(ngram_join, "COLUMNS", columns)
    rows = near_copies(3, 30, 14) + [(5000 + i, t) for i, t in enumerate(["one", "One", "one two", "", " ", None, "a b c", "A B C"])]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_join(rows)


def test_shuffled_candidates(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", -1)
    rows = near_copies(4, 12, 6)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_join(rows)


def test_join_on_documents(spark, duck, sf):
    got = rows_of(queries.op10_ngram_jaccard_join(spark, sf).toPandas())
    assert got == rows_of(duck.execute(queries.oracle_sql()["op10_ngram_jaccard_join"]).df())


def test_linked_rows_share_a_key():
    """No pair over the bound may miss all of the other's agreement keys."""
    rng = random.Random(6)
    import numpy as np

    for _ in range(3000):
        n = rng.choice([9, 10, 11, 13, 20, 37, 60, 150])
        base = [rng.getrandbits(64) for _ in range(n)]
        d = rng.randint(1, max(1, n // 9))
        a = sorted(base)
        b = sorted([*rng.sample(base, n - rng.randint(0, d)), *(rng.getrandbits(64) for _ in range(rng.randint(0, d)))])
        x, y = (set(s) for s in (a, b))
        if x != y and 100 * len(x & y) >= 90 * len(x | y):
            keys = [set(ngram_join.agreement_keys(np.array(s, np.uint64)).tolist()) for s in (a, b)]
            assert keys[0] & keys[1]


def test_join_tables(spark, awkward):
    rows = ngram_join.join(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by_id[6] == by_id[7] == {(1, 6)} and by_id[2] == {(0, 2)} and by_id[3] == {(0, 3)}
    assert {c for _, c in by_id[None]} == {None}
    one = ngram_join.keep_one(awkward)
    assert one.columns == awkward.columns and one.where("_row <> 11").isEmpty()
    kept = Counter(r["doc_id"] for r in one.collect())
    assert kept == Counter({1: 1, 2: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1})
    assert ngram_join.join(awkward.limit(0)).isEmpty() and ngram_join.keep_one(awkward.limit(0)).isEmpty()


def brute_components(rows, gram, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = frozenset([tuple(w)] if 0 < len(w) < gram else [tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)])
    out = {}
    for d in sorted(sets):
        reach, todo = {d} - set(out), [d]
        while todo and d not in out:
            a = sets[todo.pop()]
            new = [x for x, b in sets.items() if x not in reach and a and 100 * len(a & b) >= percent * len(a | b)]
            reach.update(new)
            todo += new
        out |= {x: (len(sets[x]), d) for x in reach}
    return out


@pytest.mark.parametrize("gram, percent", [(5, 80), (3, 90), (4, 50)])
def test_join_settings(spark, gram, percent):
    rows = near_copies(8, 30, 14) + [(5000 + i, t) for i, t in enumerate(["one", "One", "one two", "", None, "a b c d", "A B C D"])]
    want = brute_components(rows, gram, percent)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join(frame, gram=gram, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("percent", [50, 80, 90, 95, 100])
def test_linked_rows_share_a_key_at_any_setting(percent):
    import numpy as np

    rng = random.Random(9)
    for _ in range(3000):
        n = rng.choice([1, 2, 4, 5, 6, 8, 9, 12, 16, 31, 33, 70, 150])
        base = [rng.getrandbits(64) for _ in range(n)]
        d = rng.randint(1, max(1, n * (100 - percent) // 100))
        a = sorted(base)
        b = sorted([*rng.sample(base, n - rng.randint(0, min(n, d))), *(rng.getrandbits(64) for _ in range(rng.randint(0, d)))])
        x, y = (set(s) for s in (a, b))
        if x != y and x and y and 100 * len(x & y) >= percent * len(x | y):
            keys = [set(ngram_join.agreement_keys(np.array(s, np.uint64), percent).tolist()) for s in (a, b)]
            assert keys[0] & keys[1]


def test_keep_one_of_null_and_repeated_ids(spark):
    """One row of each group stays, also where ids are null, or where two different texts have the smallest one."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (7, a), (None, a + " end"), (9, a + " tail"), (None, b), (None, b), (None, b + " end"), (3, c), (3, c + " end"), (3, d), (None, ""), (None, None)]
    kept = Counter((r["doc_id"], (r["text"] or "")[:1]) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == Counter({(7, "a"): 1, (None, "b"): 1, (3, "c"): 1, (3, "d"): 1, (None, ""): 2})


@pytest.fixture
def large_tables(spark):
    """Tables count as too large for Spark to send them by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("copies, how", [(1, "LeftAnti"), (9, "LeftSemi")])
def test_texts_stay_where_they_are_read(spark, monkeypatch, large_tables, copies, how):
    """The rows that stay and those that go, together too many to be sent: the fewer are, and no text is shuffled."""
    monkeypatch.setattr(ngram_join, "SMALL", 40)
    rng = random.Random(21)
    bases = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(120 if copies == 1 else 12)]
    rows = list(enumerate(bases)) + [(1000 + i, t + " end") for i, t in enumerate(bases[:8])]
    rows += [(2000 + i, t) for i, t in enumerate(bases * (copies - 1))] + [(5000, ""), (5001, None), (5002, bases[0]), (5002, bases[0])]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and how in plan
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(len(bases)), 5000, 5001]


def test_shuffles_go_with_their_step(spark, large_tables):
    """Shuffle files of the agreement keys don't stay until the driver collects its garbage."""
    frame = spark.createDataFrame(near_copies(5, 12, 6), "doc_id long, text string")
    table = ngram_join.incidence(frame, "doc_id", "text")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks
    shuffles = lambda: {x for x in re.findall(r"shuffle_\w+", blocks().toString())}
    before, setting = shuffles(), spark.conf.get(common.CLEANUP)
    assert ngram_join.agreeing(table).count() > 0
    assert spark.conf.get(common.CLEANUP) == setting
    until = time.time() + 10
    while len(left := shuffles() - before) > 2 and time.time() < until:  # files go soon after the step; those of the count above stay
        time.sleep(0.1)
    assert len({x.split("_")[1] for x in left}) <= 1


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(900, i) for i in range(1000, 1100)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    lone = {a for a, b in links if a == b}
    assert {x: find(x) for x in root if x not in lone or x in got} == got
    assert components.components(spark.createDataFrame([], "u long, v long")).isEmpty()


@pytest.mark.parametrize("entries, few, columns", [(1 << 15, 24, 4096), (50, 3, 2), (7, 1, 5), (1 << 15, 300, 1)])
def test_sparse_product(monkeypatch, entries, few, columns):
    """The forest of a unit's links against all pairs of sets, whole, split and labelled, with columns of one owner and of many."""
    import numpy as np

    for name, value in (("ENTRIES", entries), ("FEW", few), ("COLUMNS", columns)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(12)
    for turn in range(40):
        percent = rng.choice([50, 80, 90])
        pool = [rng.getrandbits(64) for _ in range(60)]
        bases = [rng.sample(pool, rng.randint(5, 30)) for _ in range(4)]
        sets = [set(rng.choice(bases)) | {rng.getrandbits(64) for _ in range(rng.randint(0, 4))} for _ in range(rng.randint(2, 40))]
        split = rng.choice([None, rng.randint(0, len(sets))])
        labels = [rng.randrange(6) for _ in sets] if turn % 2 else None
        edges = [
            (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and (split is None or i < split <= j) and (labels is None or labels[i] != labels[j])
        ]
        got = ngram_join.linked([np.array(sorted(s), np.uint64) for s in sets], split, labels, percent)
        assert set(got) <= set(edges) and len(got) <= max(0, len(sets) - 1)
        assert forest(len(sets), got) == forest(len(sets), edges)


def forest(n, edges):
    root = list(range(n))
    for a, b in edges:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_rows_that_agree_and_do_not_link(spark, monkeypatch):
    """Groups of many blocks that never become one component: a long shared passage under own text, chains of drifting copies, repeated ids and nulls."""
    monkeypatch.setattr(ngram_join, "ROWS", 5)
    rng = random.Random(14)
    vocab = [f"v{i}" for i in range(5000)]
    shared = rng.choices(vocab, k=120)
    rows = [(i, " ".join([*shared, *rng.choices(vocab, k=rng.choice([15, 30, 45]))])) for i in range(60)]
    words = rng.choices(vocab, k=90)
    for i in range(100, 150):
        words = edited(rng, words, vocab, rng.choice([1, 2, 3, 5]))
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[i][1] + " tail") for i in range(0, 60, 7)]
    want = brute_join(rows)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert 60 < len({c for _, c in want.values()}) < len(rows)
    mixed_ids = [(None if i % 3 == 0 else i // 2, t) for i, t in rows]
    kept = ngram_join.keep_one(spark.createDataFrame(mixed_ids, "doc_id long, text string")).count()
    assert kept == len({c for _, c in want.values()})


@pytest.mark.parametrize("low, high, count", [(1, 5, 120), (6, 14, 120), (15, 60, 100), (61, 130, 60), (131, 400, 25), (401, 1000, 8), (1001, 2000, 4)])
@pytest.mark.parametrize("kinds", [3, 1])
def test_recall_by_length(low, high, count, kinds):
    """Items with all allowed edits (of every kind, or substitutions only) are found at every length."""
    rng = random.Random(low + kinds)
    vocab = ["w" + "".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    items = [rng.choices(vocab, k=rng.randint(low, high)) for _ in range(count)]
    index = decontaminate.Index([(i, " ".join(w)) for i, w in enumerate(items)])

    def changed(w):
        n = decontaminate.allowed(len(w))
        if kinds == 3:
            return edited(rng, w, vocab, n)
        w = list(w)
        for p in rng.sample(range(len(w)), n):
            w[p] = rng.choice(vocab)
        return w

    found = index.search([" ".join([*rng.choices(vocab, k=70), *changed(w), *rng.choices(vocab, k=40)]) for w in items])
    assert sum(any(h[0] == i for h in hits) for i, hits in enumerate(found)) >= 0.95 * count


def test_shared_openings_cost_linear_time():
    """Many items with one opening, against a text that repeats it: work grows with the text and the items, not with their product."""
    import time

    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(5000)]
    opening = ["which", "of", "the", "following", "is"]
    items = [[*opening, *rng.choices(vocab, k=20)] for _ in range(4000)]
    text = " ".join(w for _ in range(300) for w in [*opening, *rng.choices(vocab, k=20)])
    index = decontaminate.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    began = time.perf_counter()
    found = index.search([text, text + " " + " ".join(items[17])])
    assert time.perf_counter() - began < 5
    assert not found[0] and [h[0] for h in found[1]] == [17]


def test_seeds():
    rng = random.Random(3)
    for _ in range(300):
        n, size = rng.randint(3, 12), rng.randint(1, 3)
        held = [rng.randint(0, 9) for _ in range(n - size + 1)]
        count = rng.randint(1, n // size)
        got = decontaminate.seeds(held, count, size)
        import itertools

        sets = [c for c in itertools.combinations(range(len(held)), count) if all(b - a >= size for a, b in zip(c, c[1:], strict=False))]
        assert tuple(got) in sets and sum(held[i] for i in got) == min(sum(held[i] for i in c) for c in sets)


def test_decontamination_query_exhaustively(spark, sf):
    """The query against the edit distance of every item to every run of every document."""
    bench = {r["item_id"]: decontaminate.words_of(r["text"] or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = decontaminate.words_of(r["text"] or "")
        own = set(words)
        for i, item in bench.items():
            if item and sum(w not in own for w in item) <= decontaminate.allowed(len(item)):
                best, _ = decontaminate.edit_distance_within(item, words)
                if best <= decontaminate.allowed(len(item)):
                    want[r["doc_id"], i] = best
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.op2_decontamination(spark, sf).collect()}
    assert got == want and want


@pytest.mark.parametrize("max_rules", [100, 0])
def test_null_and_repeated_rules(spark, max_rules):
    rules = spark.createDataFrame([("a.com", "/", "allow"), ("a.com", "/", "block"), (None, "/", "block"), ("a.com", None, "block"), ("a.com", "/x", None), ("a.com", "/x/y", "allow")], "host string, path string, verdict string")
    long = "http://www.a.com/x/y" + "z" * 200_000
    pages = spark.createDataFrame([(1, "http://a.com/x", 5, "h"), (1, "http://a.com/x", 5, "h"), (2, long, 5, "h"), (None, None, 5, "h"), (3, "http://b.com/", 5, "h")], "page_id long, url string, key int, host string")
    got = Counter((r["page_id"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, rules, max_rules=max_rules).collect())
    assert got == Counter({(1, "a.com/", "block"): 2, (2, "a.com/x/y", "allow"): 1, (None, None, "allow"): 1, (3, None, "allow"): 1})


def test_shards_of_other_ids(spark):
    """String ids, among them of a group that has to be cut, and language tags that begin alike."""
    rows = [(f"id-{i}", "copy " * 60, "en-US") for i in range(500)] + [(None, f"text {i} " * 30, "en-GB") for i in range(300)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id string, text string, lang string"), 4).collect()
    assert len(found) == 800 and check_shards(found, 4, 0.1) <= 2
    tags = [(i, "x" * 40, ("en-US", "en-GB")[i % 2]) for i in range(400)]
    keys = sharding.compact(spark.createDataFrame(tags, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert keys.select("k_language").distinct().count() == 2
