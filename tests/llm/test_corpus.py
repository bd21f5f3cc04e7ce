"""HTML extraction, embeddings, mixing and the pipeline."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prunescan.llm import decontamination, embedding_dedup, html_wrappers as H, mixing, simhash
from tests.llm.conftest import prose


def page(i, body, host="h.example.com"):
    return (i, f"http://{host}/p/{i}", body)


def shell(body, n):
    return f'<html><head><title>T{n}</title><script>var x = "<p>no</p>";</script></head><body><nav><a href="/">Home</a></nav>{body}<footer>&copy; site</footer></body></html>'


CASES = {
    "plain": ("<article><h1>Ti&amp;tle</h1><p>One <b>bo</b>ld&nbsp;two<br>three</p><p>Four</p></article>", "Ti&tle\n\nOne bold two three\n\nFour"),
    "unclosed": ("<article><p><b>One<br><p>Two<ul><li>a<li>b</ul>tail</article>", "One\n\nTwo\n\na\n\nb\n\ntail"),
    "comments": ("<article><p>Body</p><section id='comments'><p>Great post</p></section></article><div class='comment-list'><p>Hey</p></div>", "Body"),
    "sidebar": ("<aside><p>Links links links links</p></aside><main><p>Body text</p><form><p>Mail <input></p></form></main>", "Body text"),
    "no landmarks": ("<div class='menu'><a href=x>A</a><a href=y>B</a></div><div><div><p>Long enough body text here.</p><p>More.</p></div></div><div class='cookie-notice'>Accept</div>", "Long enough body text here.\n\nMore."),
    "header in article": ("<article><header><h1>Head</h1><p>By someone</p></header><p>Text</p></article>", "Head\n\nText"),
    "hidden": ("<article><p>Seen</p><p hidden>Not</p><div style='display: none'>Nor this</div><div aria-hidden=true>nor</div><!-- nor <p>this</p> --></article>", "Seen"),
    "table": ("<article><table><tr><td>a</td><td>b</td></tr><tr><td>c<td>d</table></article>", "a b\n\nc d"),
    "adverts": ("<article><p>Read on.</p><div class='ad banner'>Buy</div><p>Shadow adder</p></article>", "Read on.\n\nShadow adder"),
}


@pytest.mark.parametrize("name", CASES)
def test_articles(name):
    body, text = CASES[name]
    assert H.extract(shell(body, 1)) == text


def test_odd_html():
    for html in ("", "<", "<>", "text only", "<p", "<!--", "<script>", "&#xZZ; &am &copy", "<div" * 50, "</p></div>", "<a b='c", "\x00<p>\x00"):
        assert isinstance(H.extract(html), str)
    assert H.extract("text &am &amp only") == "text &am & only"
    deep = H.extract("<div>" * 3000 + "<p>deep</p>")
    assert deep == "deep"


def test_wrapper_has_slots_options_and_repeats():
    pages = [f"<div><h1>T{i}</h1>{'<p>x%d</p>' % i * (i + 1)}{'<em>hot</em>' if i % 2 else ''}<span>Share this</span></div>" for i in range(6)]
    w = H.infer(pages)
    assert str(w) == "<#root><div><h1>#SLOT</h1>(<p>#SLOT</p>)+(<em>#TEXT</em>)?<span>#TEXT</span></div></#root>"
    assert H.plan(w, 5) == H.Plan({"/#root/div"}, set(), {("/#root/div/span", H.text_key("Share this"))})
    assert str(H.Part.unpacked(w.packed())) == str(w)
    rows = "".join(f"<dt>k{i}</dt><dd>v{i}</dd>" for i in range(5))
    assert str(H.infer([f"<dl>{rows}</dl>"])) == "<#root><dl>(<dt>#SLOT</dt><dd>#SLOT</dd>)+</dl></#root>"


def test_nothing_else_of_an_article_is_dropped():
    body = "<article><h2>One</h2><p>Short.</p></article><article><p>The second one is longer than the first.</p><div class='legal'>Legal matters.</div><p class='share'>Shares fell.</p><p><a href=x>All of this is a link</a></p></article>"
    assert H.extract(shell(body, 1)) == "One\n\nShort.\n\nThe second one is longer than the first.\n\nLegal matters.\n\nShares fell.\n\nAll of this is a link"
    pages = [shell(f"<div><ul><li><a href=x>a{i}</a><li><a href=y>b</a></ul><div><p>{prose(i, 30)}</p><p><a href=x>All a link {i}</a></p><p>{prose(-i, 9)}</p></div></div>", i) for i in range(8)]
    known = H.plan(H.infer(pages), 5)
    assert H.extract(pages[3], known) == f"{prose(3, 30)}\n\nAll a link 3\n\n{prose(-3, 9)}"


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, n))] for n in (9, 7))
        got = H._matched(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        brute = max(n for n in range(len(b) + 1) for c in itertools.combinations(b, n) if is_within(c, a))
        assert len(got) == brute
    monkeypatch.setattr(H, "MOST_CELLS", 4)
    for _ in range(300):
        a, b = (rng.sample(range(40), rng.randint(5, 30)) for _ in "ab")
        got = H._matched(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        assert len(got) == len(H._longest_match(a, b))  # every sign stands once


def is_within(c, a):
    it = iter(a)
    return all(x in it for x in c)


def test_deep_and_wide_pages():
    deep = ["<div>" * 1500 + f"<p>deep {i}</p><nav>menu</nav><p>more {i}</p>" for i in range(6)]
    known = H.plan(H.infer(deep), 5)
    assert H.extract(deep[2], known) == "deep 2\n\nmore 2"
    wide = ["<article>" + "".join(f"<x{(k * 7 + i * 13) % 5003}>t{k} </x{(k * 7 + i * 13) % 5003}>" for k in range(5000)) + "</article>" for i in range(4)]
    began = time.perf_counter()
    known = H.plan(H.infer(wide), 3)
    assert H.extract(wide[1], known).split() == [f"t{k}" for k in range(5000)] and time.perf_counter() - began < 20


def site(rng, landmark):
    """A page maker of a made-up template and the text it plants."""
    names = [rng.choice(["box", "col", "wrap", "pane"]) + str(rng.randint(1, 9)) for _ in range(6)]
    extras = rng.sample(["nav", "aside", "footer", "ad", "comments", "form", "cookie", "fixed"], 6)
    tag = "article" if landmark == "article" else "main" if landmark == "main" else "div"

    def make(i):
        title, paragraphs = prose(i * 7, 4), [prose(i * 31 + k, rng.randint(12, 40)) for k in range(rng.randint(2, 7))]
        inner = f"<h1>{title}</h1>" + "".join(f"<p>{p[:20]}<b>{p[20:30]}</b>{p[30:]}</p>" for p in paragraphs)
        part = {
            "nav": "<nav><ul>" + "".join(f"<li><a href=x>{prose(i + k, 1)}</a></li>" for k in range(rng.randint(2, 6))) + "</ul></nav>",
            "aside": f"<aside class='{names[0]}'><p>{prose(i + 5, 8)}</p></aside>",
            "footer": f"<footer>&copy; {prose(i % 3, 3)}</footer>",
            "ad": f"<div class='ad {names[1]}'>{prose(i % 4, 6)}</div>",
            "comments": "<section id='comments'>" + "".join(f"<p>{prose(i + k, 5)}</p>" for k in range(i % 4)) + "</section>",
            "form": "<form><p>Your mail <input></p><button>Send</button></form>",
            "cookie": "<div class='cookie-notice'>We use them.</div>",
            "fixed": f"<div class='{names[2]}'><p>Welcome to the site of all sites</p></div>",
        }
        before, after = [part[x] for x in extras[:3]], [part[x] for x in extras[3:]]
        body = "".join(before) + f"<{tag} class='{names[3]}'>{inner}</{tag}>" + "".join(after)
        if landmark == "none":
            body = f"<div class='{names[4]}'><div class='{names[5]}x'>{body}</div></div>"
        text = "\n\n".join([title, *paragraphs])
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}<script>f('<p>no</p>')</script></body></html>", text

    return make


def test_articles_of_generated_sites(spark, monkeypatch):
    """Every planted text of 18 templates comes back whole and alone; groups of 4 wrappers, so several levels."""
    monkeypatch.setattr(H, "FAN_IN", 4)
    rng, rows, want = random.Random(9), [], {}
    for k in range(18):
        make = site(rng, ["article", "main", "none"][k % 3])
        for i in range(8 + 10 * (k % 4)):
            page_, text = make(1000 * k + i)
            want[len(rows)] = text
            rows.append((len(rows), f"http://s{k}.example.com/{i}", page_))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = H.extract_articles(df).collect()
    assert {r.page_id: r.text for r in got} == want
    again = H.extract_articles(df.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    w = {r.host: r for r in H.wrappers(df).collect()}
    assert len(w) == 18 and all(w[f"s{k}.example.com"].n_pages == 8 + 10 * (k % 4) for k in range(18))


def test_copies_are_no_boilerplate(spark):
    text = [prose(k, 30) for k in range(6)]
    rows = [page(i, shell(f"<article><h1>{prose(1, 5)}</h1>" + "".join(f"<p>{t}</p>" for t in text) + f"<p>{prose(900 + i, 4)}</p></article>", i)) for i in range(12)]
    got = H.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: "\n\n".join([prose(1, 5), *text, prose(900 + i, 4)]) for i in range(12)}


def test_site_text_goes_article_text_stays(spark):
    rows = [page(i, shell(f"<article><p>Read more at our site</p><p>{prose(i, 20)}</p></article>", i)) for i in range(30)]
    rows += [page(100 + i, shell(f"<article><p>Read more at our site</p><p>{prose(i, 20)}</p></article>", i), "few.example.com") for i in range(2)]
    rows += [page(200, None), (201, None, "<article>kept</article>"), (None, "odd", ""), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = H.extract_articles(df)
    assert got.columns == ["page_id", "url", "host", "text", "n_chars"] and got.count() == len(rows)
    by = {r.page_id: r.text for r in got.collect()}
    assert by[3] == prose(3, 20) and by[101] == f"Read more at our site\n\n{prose(1, 20)}"
    assert by[200] == "" and by[201] == "kept" and by[None] == ""
    assert H.extract_articles(df.limit(0)).count() == 0
    assert got.filter("n_chars <> length(text)").count() == 0


def brute_vectors(rows, least=0.9):
    ok = {i: np.array(v, float) / np.linalg.norm(v) for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    link = [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= least]
    root = {i: i for i in range(len(rows))}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in link:
        root[find(a)] = find(b)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    n = [sum(i in p for p in link) for i in range(len(rows))]
    return sorted((k, n[i], min(groups[find(i)]), k == min(groups[find(i)])) for i, (k, _) in enumerate(rows))


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        base = rng.normal(size=16)
        rows += [(base + rng.normal(size=16) * s).tolist() for s in ([0, 0, 0.1, 0.2, 0.3, 0.4] if k % 3 == 0 else [0])]
    rows += [rows[0]] * 5 + [[2 * x for x in rows[0]], None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 0.0], [1.0, 0.1]]
    ids = rng.permutation(len(rows)).tolist()
    df = spark.createDataFrame(list(zip(ids, rows)), "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    got = embedding_dedup.near_duplicates(df, cells=4)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute_vectors(list(zip(ids, rows)))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("rank, dim, cells", [(6, 96, 50), (16, 192, 50), (6, 96, 200)])
def test_low_rank_vectors_in_a_high_dimension(spark, rank, dim, cells):
    """No link is missed, though linked vectors differ in few directions only."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, rank))
    partners = base[:300] + rng.normal(size=(300, rank)) * np.linspace(0.3, 0.55, 300)[:, None]
    turned = np.linalg.qr(rng.normal(size=(dim, rank)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, partners]) @ turned.T)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cells=cells)
    assert sorted(map(tuple, got.collect())) == brute_vectors(rows)


def test_very_large_and_very_small_components(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1.1e-300]), (3, [1e300, -1e300]), (4, [5e-324, 5e-324])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 2, 1, False)]


def test_crowded_cells_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.15).tolist()) for i in range(120)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cells=2)
    assert sorted(map(tuple, got.collect())) == brute_vectors(rows)


def test_only_bad_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0]), (None, None)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again until none is above its limit."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    done, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return done | share
        for s in over:
            done[s] = float(most * sizes[s])
            left -= done[s]
        open_ -= over
    return done


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 50}, {"a": 1, "b": 1, "c": 10_000}, {"a": 0, "b": 5}, {"a": 7}, {"a": 3, "b": 3, "c": 3, "d": 5000, "e": 40}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, s, n) for s, n in sizes.items()], "source string, src string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, (5, 2, 1), 3).collect()}
    assert got == pytest.approx(filled(sizes))


def test_mix(spark, odd, none):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randint(0, 300)), f"s{i % 5}" if i % 11 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(13)).collect()))
    assert len(got) == 900 and all(0 <= r.taken <= 3 * r.size and r.size == len((rows[r.doc_id][1]).split()) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert list(sorted(by, key=lambda s: (s is None, s))) == ["s0", "s1", "s2", "s3", "s4", None]
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target + 2 * 128
    assert sum(r.target for r in {r.source: r for r in got}.values()) == pytest.approx(sum(r.size for r in got))
    strange = mixing.mix(odd)
    assert strange.count() == odd.count() and strange.filter("taken > 3 * size or taken is null or target is null").count() == 0
    assert mixing.mix(none).count() == 0
    wordless = mixing.mix(odd.filter("doc_id in (2, 3, 4)"))
    assert wordless.count() == 3 and wordless.filter("taken <> 0 or target <> 0").count() == 0


def test_slots(spark):
    goal = spark.createDataFrame([("a", 1000, 2500.0), ("b", 90, 0.0), ("c", 64, 64.0)], "src string, source_size long, target double")
    slots = mixing.draw(goal, 10, 16, 1)
    times = {}
    for r in slots.collect():
        times.setdefault(r.src, []).append(r.block)
    assert len(times["a"]) == 250 and "b" not in times and sorted(times["c"]) == list(range(7))
    count = [times["a"].count(b) for b in range(100)]
    assert set(count) == {2, 3} and sum(count) == 250
    shards = [r["count"] for r in slots.groupBy("shard").count().collect()]
    assert sum(shards) == 257 and len(shards) == 17 and max(abs(n - 16) for n in shards[:-1]) <= 16
    for n in (1, 2, 7, 16777213, 16777199 * 2):
        step = spark.range(min(n, 5000)).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.turns(F.lit(n).cast("long"), F.lit("key"))).alias("x"))
        assert step.distinct().count() == min(n, 5000) and step.filter(f"x < 0 or x >= {n}").count() == 0


def test_shard_counts_are_multinomial_and_meet_the_targets(spark):
    share = {"a": 0.5, "b": 0.2, "c": 0.2, "d": 0.1}
    shards, slots = 600, 250
    rows = [(s, 10 * 100_000, 10.0 * p * shards * slots) for s, p in share.items()] + [("rare", 10, 10.0)]
    got = mixing.shard_counts(spark.createDataFrame(rows, "src string, source_size long, target double"), 10, slots, 7).collect()
    count = {s: [0] * shards for s in share}
    for r in got:
        if r.src != "rare" and r.shard < shards:
            count[r.src][r.shard] = r["count"]
    for s, p in share.items():
        own = np.array(count[s][:-1])
        want = p * slots
        chi = ((own - want) ** 2 / (want * (1 - p))).sum()  # chi-square, one degree of freedom a shard
        assert abs(chi - (shards - 1)) < 5 * (2 * shards) ** 0.5
    total = {}
    for r in got:
        total[r.src] = total.get(r.src, 0) + r["count"]
    assert total == {s: round(p * shards * slots) for s, p in share.items()} | {"rare": 1}
    ends = sorted((r.src, r["first"], r["first"] + r["count"]) for r in got if r["count"])
    assert all(x[0] != y[0] or x[2] == y[1] for x, y in zip(ends, ends[1:]))


def test_permutations_look_random(spark):
    n = 600
    image = [r.x for r in spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.turns(F.lit(n).cast("long"), F.lit("k2"))).alias("x")).orderBy("id").collect()]
    steps = np.diff(image)
    assert len(set(steps.tolist())) > 350 and abs(np.corrcoef(np.arange(n), image)[0, 1]) < 0.15


def test_pipeline(spark, tmp_path):
    """Each stage against what was put in."""
    rng, docs, labels = random.Random(31), [], []
    items = [(k, prose(7000 + k, 30)) for k in range(5)]
    kind = {}
    for i in range(600):
        words = prose(40_000 + i, rng.randint(60, 160)).split()
        kind[i] = "clean"
        if i % 7 == 0:
            kind[i] = "toxic"
            words[10:10] = ["vilea", "vileb", "vilec"]
        elif i % 7 == 1 and i > 10:
            kind[i] = "leak"
            words[20:20] = items[i % 5][1].split()
        elif i % 7 == 2 and i > 10:
            kind[i] = "copy"
            words = docs[i - 5][1].split() if kind[i - 5] == "clean" else docs[4][1].split()
            words[3] = f"edited{i}"
        elif i % 7 == 3:
            kind[i] = "private"
            words[5:5] = [f"u{i}@mail.example.com"]
        docs.append((i, " ".join(words), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(kind[i] == "toxic")))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = corpus_pipeline.stored(stage(spark, d, str(tmp_path)))
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in d.select("doc_id").collect()})
    toxic, copies, leaks = seen[0], seen[1], seen[2]
    assert toxic == {i for i, k in kind.items() if k != "toxic"}
    assert copies == {i for i in toxic if kind[i] != "copy"}
    assert leaks == seen[3] == {i for i in copies if kind[i] != "leak"}
    assert d.filter("text like '%mail.example.com%'").count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and {r.doc_id for r in out.collect()} == leaks
    assert [n for n, _ in corpus_pipeline.STAGES][1:3] == ["simhash_near_dedup", "decontamination"] and simhash and decontamination


def test_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls, blanks, long and repeated texts, an extra column of a working name, and no rows at all."""
    docs = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", F.col("size").alias("n_chars"), F.lit("x").alias("_bad"), F.lit("y").alias("masked"))
    spark.createDataFrame([(5, None, None), (None, 1, 1), (8, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None), (1, ""), (2, prose(8, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.stored(stage(spark, d, str(tmp_path)))
            assert out.columns == docs.columns and out.count() <= d.count()
        assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() == d.count()
    assert corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).filter("doc_id in (8, 9)").count() == 0
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, str(tmp_path)).collect()} == {1, 2, None, 5, 7, 8}


def test_near_dedup_of_the_pipeline_goes_by_simhash(spark, tmp_path):
    """Texts whose fingerprints agree while their sets of five words are unlike are copies."""
    texts = [" ".join(prose(3000 + k, 7).split() * 60 + prose(4000 + 2 * k + e, 12).split()) for k in range(20) for e in (0, 1)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    named = {r.doc_id for r in simhash.simhash_groups(docs).filter("doc_id = component_id").collect()}
    assert len(named) < len(texts)
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, str(tmp_path)).collect()} == named


def test_alignment_at_any_size_is_a_longest_common_subsequence(monkeypatch):
    """Streams of few signs, which no anchors divide; the same places are matched whatever part of the table is held."""

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b):
                left, row[j + 1] = row[j + 1], left + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng, found = random.Random(12), {}
    streams = [([rng.choice("abcde") for _ in range(rng.randint(280, 400))], [rng.choice("abcde") for _ in range(rng.randint(280, 400))]) for _ in range(6)]
    for most in (4, 1 << 16, 1 << 30):
        monkeypatch.setattr(H, "MOST_CELLS", most)
        found[most] = [H._matched(a, b) for a, b in streams]
        for (a, b), got in zip(streams, found[most]):
            assert len(got) == longest(a, b) and all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert found[4] == found[1 << 16] == found[1 << 30]
    a, b = ([rng.choice("abcdefgh") for _ in range(20_000)] for _ in "ab")
    began = time.perf_counter()
    assert len(H._longest_match(a, b)) > 8_000 and time.perf_counter() - began < 20
