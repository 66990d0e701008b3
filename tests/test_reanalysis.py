from websift.streaming import reanalysis as RA
from websift.streaming.streams import RANKED_SCHEMA


def html(title, metas, links):
    return "<html><head><title>" + title + "</title>" + "".join(f'<meta name="x" content="{m}">' for m in metas) + "</head><body>word " + title + \
        "".join(f'<a href="https://{x}.example/">{x}</a>' for x in links) + "</body></html>"


def test_accepted_votes_replace_website_children_and_terms(spark, tmp_path):
    pages = [(k, 1, f"u{k}", html(f"old{k}", ["m"], ["a", "b"])) for k in range(1, 6)]
    pages += [(k, v, f"u{k}", html(f"new{k}v{v}", [], ["c"])) for k in (1, 2, 4) for v in (2, 3)]
    snapshots = spark.createDataFrame(pages, "page_id long, version long, url string, html string")
    store, src = RA.Store(spark, str(tmp_path / "store")), str(tmp_path / "votes")
    store.write(RA.extract(snapshots.where("version = 1")))

    def state():
        links, metas = {}, {}
        for r in store.read("links").collect():
            links.setdefault(r.website_id, []).append(r.href)
        for r in store.read("metadata").collect():
            metas.setdefault(r.website_id, []).append(r.metadata_text)
        terms = {}
        for r in store.index().collect():
            terms.setdefault(r.doc_id, set()).add(r.term)
        return {r.id: (r.title, sorted(links.get(r.id, [])), len(metas.get(r.id, [])), terms[r.id]) for r in store.read("websites").collect()}

    def votes(rows):
        spark.createDataFrame(rows, RANKED_SCHEMA).write.mode("append").parquet(src)
        RA.run_reanalysis(spark, src, RANKED_SCHEMA, snapshots, store)

    def old(k):
        return f"old{k}", ["https://a.example/", "https://b.example/"], 2, {f"old{k}", "word", "a", "b"}
    before = state()
    assert {k: v[:2] for k, v in before.items()} == {k: old(k)[:2] for k in range(1, 6)}
    # accepted twice, rejected, without a newer snapshot, without any page
    votes([(1, 1, True, 1.0), (2, 1, True, 2.0), (3, 2, False, None), (4, 3, True, 1.0), (5, 99, True, 1.0)])
    now = state()
    assert now[1][:3] == ("new1v3", ["https://c.example/"], 0)
    assert {k: now[k] for k in (2, 3, 4, 5)} == {k: before[k] for k in (2, 3, 4, 5)} and "old1" not in now[1][3] and "new1v3" in now[1][3]
    votes([(6, 2, True, 1.0), (7, 1, True, 1.0)])
    again = state()
    assert again[2][:3] == ("new2v3", ["https://c.example/"], 0) and again[1] == now[1] and again[4] == before[4] and len(again) == 5
