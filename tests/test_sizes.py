"""Size texts of keys whose powers are beyond any integer."""

from wayline.catalog import QUERIES


def test_sizes_beyond_an_integer(spark, tmp_path):
    keys = [0, 1, 2, 8, 30, 31, 1022, 1023, 104_030, 149_999, 2_097_149, 2_097_151, 2_097_152, 8_999_999, 53_999_999, 3_037_000_498, 3_037_000_501, 2**40, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey BIGINT").write.parquet(str(tmp_path / "orders.parquet"))

    def want(k, units):
        n = (k + 1) ** (1 + k % 3)
        if n < 1024:
            return f"{n}{units[0]}"
        power = next((p for p in range(1, 5) if n < 1024 ** (p + 1)), 4)
        return f"{n / 1024**power:.2f}{units[power]}"

    got = {r.o_orderkey: (r.short_text, r.long_text) for r in QUERIES["size_texts"](spark, str(tmp_path)).collect()}
    assert got.pop(None) == (None, None)
    assert got == {k: (want(k, "BKMGT"), want(k, (" B", " KB", " MB", " GB", " TB"))) for k in keys if k is not None}
