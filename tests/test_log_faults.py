from cartloom.sources.files import read_url_log_checked

LINES = [
    "URL,Store_ID,ids", "http://a,1,x", "http://b,2", 'http://c,3,"y,z",more,"and, more"', '"http://d\nd",4,"say ""so"""', "", ",,", "http://e", "http://f,6,", "http://g,7,p,q",
]


def test_every_row_is_read_or_put_aside(spark, tmp_path):
    (tmp_path / "one.csv").write_text("\n".join(LINES) + "\n")
    (tmp_path / "two.csv").write_text("URL,Store_ID,ids\nhttp://h,8,x\n")
    whole, faulty = read_url_log_checked(spark, str(tmp_path))
    got = {(r.url, r.store_id, r.url_ids_csv) for r in whole.collect()}
    assert got == {("http://a", "1", "x"), ("http://d\nd", "4", 'say "so"'), (None, None, None), ("http://f", "6", None), ("http://h", "8", "x")}
    found = sorted((r.file, r.fault, r.raw.strip()) for r in faulty.collect())
    assert found == sorted([("one.csv", "short", "http://b,2"), ("one.csv", "long", LINES[3]), ("one.csv", "short", "http://e"), ("one.csv", "long", "http://g,7,p,q")])
    # a few columns alone tell the same
    assert whole.select("url").count() == 5 and faulty.select("fault").count() == 4


def test_files_that_spark_may_split_and_empty_ones(spark, tmp_path):
    (tmp_path / "one.csv").write_text("store_id,url\n1,u\n2\n3,u,v\n")
    whole, faulty = read_url_log_checked(spark, str(tmp_path), quoted_breaks=False)
    assert [r.store_id for r in whole.collect()] == ["1"] and sorted(r.fault for r in faulty.collect()) == ["long", "short"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("store_id,url\n")
    whole, faulty = read_url_log_checked(spark, f"{tmp_path}/none")
    assert whole.collect() == [] and faulty.collect() == []
