"""What a round of the causal index hears is made once: its news are read from the written facts alone."""

from causeway.operators import order


def test_news_of_a_round_read_only_what_the_round_has_written(spark, monkeypatch):
    read, real = {}, order.written

    def written(df, path):
        if "/labels/round=" in path:
            read[int(path.rsplit("=", 1)[1])] = df.inputFiles()
        return real(df, path)

    monkeypatch.setattr(order, "written", written)
    edges = [(1, 0, 2, 1), (2, 1, 3, 1), (3, 1, 4, 1), (4, 1, 1, 1), (1, 1, 2, 2)]
    index = order.causal_index(spark.createDataFrame(edges, "src_probe long, src_ticks long, dst_probe long, dst_ticks long"))
    got = {tuple(r) for r in index.select("probe_id", "ticks", "known_probe", "known_ticks").collect()}
    assert got == {(2, 1, 1, 0), (3, 1, 2, 1), (4, 1, 3, 1), (1, 1, 4, 1), (2, 2, 1, 1), (3, 1, 1, 0), (4, 1, 2, 1), (1, 1, 3, 1), (2, 2, 4, 1), (4, 1, 1, 0), (1, 1, 2, 1), (2, 2, 3, 1)}
    assert len(read) >= 3 and all(files and all(f"/step{n}/" in f for f in files) for n, files in read.items())
