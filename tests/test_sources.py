"""Reading and writing files, and the large-dictionary path."""

from postlens.operators import terms as T
from postlens.sources import landing as L


def test_queue_csv_with_foreign_headers(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Job URL,Full Name,E-mail / email,Priority level,Notes\n https://a.b/1 ,Ann,"a@x.io",HIGH,"late, or not"\n,Bob,b@x.io,,\nhttps://a.b/2,Cy,,,\n')
    got = L.read_queue(spark, str(tmp_path / "q.csv")).orderBy("id").collect()
    assert [(r.job_url, r.candidate_name, r.email, r.priority, r.notes, r.status, r.selected) for r in got] == [
        ("https://a.b/1", "Ann", "a@x.io", "high", "late, or not", "pending", True), ("https://a.b/2", "Cy", "", "medium", "", "pending", True)]


def test_url_list_goes_behind_the_queue(spark, tmp_path):
    (tmp_path / "u.txt").write_text("  https://a.b/9  \nnot a url\nHTTP://c.d/1\n")
    urls = L.read_url_list(spark, str(tmp_path / "u.txt"))
    queue = L.as_queue(spark.createDataFrame([(4, "https://a.b/1")], "seq long, url string"), "seq")
    out = L.append_urls(queue, urls).orderBy("id").collect()
    assert [r.job_url for r in out] == ["https://a.b/1", "https://a.b/9", "HTTP://c.d/1"] and out[0].id == 4 and out[1].id > 4


def test_cities_prefer_ranked_countries(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"name":"Paris","country":"us"}\n{"name":"Paris","country":"FR"}\n{"name":"Kraków","country":"PL"}\n{"name":"","country":"PL"}\n')
    got = {r.city_key: r.country_iso2 for r in L.read_cities(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"paris": "US", "kraków": "PL", "krakow": "PL"}


def test_thin_api_answers_fall_through(spark):
    long = "x" * 90
    rows = spark.createDataFrame([("greenhouse", '{"title":" Dev ","content":"<p>%s</p>","location":{"name":"Cork"}}' % long), ("greenhouse", '{"title":"Dev","content":"short"}'), ("workday", "{broken")], "platform string, payload string")
    got = L.posting_from_api(rows).collect()
    assert [(r.found, r.title, r.location) for r in got] == [(True, "Dev", "Cork"), (False, "", ""), (False, "", "")]


def test_large_dictionaries_give_the_same_hits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    terms = spark.createDataFrame([("the", "a"), ("of the", "b"), ("que la", "b"), ("thon", "c")], "term string, category string")
    small = sorted(map(tuple, T.dictionary_hits(docs, terms).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the dictionary were too large to broadcast
    large = sorted(map(tuple, T.dictionary_hits(docs, terms).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert small == large and small
