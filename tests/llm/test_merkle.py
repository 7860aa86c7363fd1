import hashlib
import random
import zlib

from arealith.llm.merkle import manifest

COLS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    d, text, lang, source, n = row[:5]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n if n is None else n + more, text)))


def fold(nodes):
    """Root of a run of nodes, and each node's siblings with their side."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            if i ^ 1 < len(level):
                ways[k].append((level[i ^ 1], i & 1))
            else:
                ways[k].append((None, 0))
        at = [i // 2 for i in at]
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], ways


def climb(node, way):
    for sibling, right in way:
        node = H(node) if sibling is None else H(sibling, node) if right else H(node, sibling)
    return node


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = {}
    for name in names:
        own = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        low[name] = (own, *fold([leaf(r) for r in own]))
    root, ups = fold([low[name][1] for name in names])
    out = []
    for name, up in zip(names, ups, strict=True):
        own, sub, ways = low[name]
        for r, way in zip(own, ways, strict=True):
            start = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            found = climb(start, way + up)
            out.append((r[0], leaf(r), sub, root, H(*(s for s, _ in way + up if s)), found, found == root))
    return out


def check(spark, rows, parts=3):
    got = [tuple(r) for r in manifest(spark.createDataFrame(rows, COLS).repartition(parts)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    return got


def test_manifest_equals_brute_force(spark):
    rng = random.Random(3)
    langs = [None, "", "de", "en", "fr", "éé", "z" * 40]
    rows = [(k, rng.choice(["", "a", "naïve\n", "日本語", "x" * 3000]) + str(k), rng.choices(langs, [2, 1, 2, 30, 9, 1, 0.2])[0], rng.choice([None, "s", "t"]), rng.choice([None, 0, k]), "c", "c") for k in range(700)]
    got = check(spark, rows)
    assert any(not r[6] for r in got) and sum(r[6] for r in got) > 500


def test_nulls_repeats_and_ids(spark):
    same = (14, "same", "en", "s", 5, "c", "c")
    rows = [same] * 20 + [(None, None, None, None, None, None, None)] * 3 + [(None, "t", "en", None, 1, "", "")] * 2 + [(14, "other", "en", "s", 5, "c", "c"), (-3, "", "en", "", 0, "", "")]
    check(spark, rows)


def test_small_trees(spark):
    one = (8, "only", "en", "s", 4, "c", "c")
    for rows in ([one], [one, (9, "two", "de", "s", 3, "c", "c")], [(k, "t", "en", "s", 1, "c", "c") for k in range(17)], [(k, "t", f"l{k}", "s", 1, "c", "c") for k in range(19)]):
        check(spark, rows, 1)
    assert manifest(spark.createDataFrame([], COLS)).collect() == []
