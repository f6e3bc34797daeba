"""Page extraction on hand-made pages, streaming ingest, price model."""

import pytest
from pyspark.sql import functions as F

from rentalytics import constants as C
from rentalytics.functions import html as H
from rentalytics.operators import pages as P
from rentalytics.operators import pricing as M
from rentalytics.sources import writers as O
from rentalytics.streaming import ingest as T


def page(body="", title="Loft - Paris, France - Stays", head=""):
    return f"<html><head><title>{title}</title>{head}</head><body>{body}</body></html>"


@pytest.fixture(scope="module")
def make(spark):
    def build(*htmls, url="https://stay.example.com/rooms/7?x=1"):
        rows = [(i, url if isinstance(h, str) else h[0], h if isinstance(h, str) else h[1]) for i, h in enumerate(htmls)]
        return spark.createDataFrame(rows, "page_id long, url string, html string")
    return build


def parsed(df):
    return P.found_json(P.page_text(df))


def one(df, column):
    return [r[0] for r in df.orderBy("page_id").select(column).collect()]


@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    """Columns need a running session."""
    globals().update({c.upper(): F.col(c) for c in ("text", "html", "scripts", "found")})


def test_error_pages_are_dropped(make):
    df = make(page(title="Oops!"), page(title="Page NOT found"), page("<h1>oops</h1>"), page("<h1>ok</h1>"))
    assert [r.page_id for r in P.drop_error_pages(df).collect()] == [3]


def test_links_are_canonical_and_kept_once(make):
    df = make(page('<a href="/rooms/1?a=1">x</a><a class=c href="https://stay.example.com/rooms/1">y</a>'
                   '<a href="/help">z</a><a href="https://o.example.com/rooms/2#s">w</a>'),
              page('<a href="/rooms/1">x</a><a href="/rooms/3">x</a>'))
    got = {(r.url, r.page_id, r.position) for r in P.listing_urls(df).collect()}
    assert got == {("https://stay.example.com/rooms/1", 0, 0), ("https://o.example.com/rooms/2#s", 0, 1),
                   ("https://stay.example.com/rooms/3", 1, 1)}


def test_search_prices_follow_link_order(make):
    df = make(page('<a href="/rooms/1">a</a><a href="/rooms/2">b</a><a href="/rooms/3">c</a>'
                   '<span class="price">$3</span><span class="x price">$80 night</span><span class="price">$95</span>'))
    got = {r.url[-1]: r.search_price for r in P.search_prices(df).collect()}
    assert got == {"1": 80, "2": 95, "3": None}


def test_urls(make):
    df = make(page(), ("https://stay.example.com/s/New-York/homes?q=1", page()), ("http://a.example.com/x?currency=EUR", page()))
    assert one(df, H.with_currency("url")) == [
        "https://stay.example.com/rooms/7?x=1&currency=USD",
        "https://stay.example.com/s/New-York/homes?q=1&currency=USD", "http://a.example.com/x?currency=EUR"]
    keys = one(df, P.page_listing_id())
    assert keys[0] == "7" and keys[1].startswith("scraped_") and keys[1] != keys[2]


def test_visible_text(make):
    df = P.page_text(make(page(
        "<h1>A &amp; B</h1><h2>One</h2><h2>Two <b>x</b></h2><script>var t='</p>';</script><!-- no --><p>x&nbsp;y</p>",
        head="<style>p{}</style>")))
    r = df.first()
    assert (r.title, r.h1, r.h2) == ("Loft - Paris, France - Stays", "A & B", ["One", "Two x"])
    assert r.page_text == "A & B One Two x x y" and r.scripts == "var t='</p>';"


def test_city(make):
    df = P.page_text(make(page(), ("https://stay.example.com/s/new-york/homes", page()),
                          ("https://stay.example.com/rooms/1?a=1&city=san%20jose", page()), page(title="plain")))
    assert one(df, P.page_city("Stays")) == ["Paris", "New York", "San Jose", None]
    assert one(df, P.page_city("Stays", F.lit("Oslo"))) == ["Oslo"] * 4
    assert one(df, P.city_from_title_part("Stays"))[0] == "Paris"
    assert one(df, P.city_from_title_part("Stays"))[3] is None


def test_counts_and_beds_look_ahead(make):
    df = parsed(make(page("12 bedrooms 3 beds 2 baths 4 guests")))
    r = df.select(*[c.alias(n) for n, c in P.room_counts(TEXT).items()]).first()
    assert (r.person_capacity, r.bedrooms, r.beds, r.bathrooms) == (4, 12, 3, 2)


def json_page(kind, text, body=""):
    return page(body, head=f'<script {kind}>{text}</script>')


def test_json_search_order_and_missing_values(make):
    state, linked, plain = 'id="__NEXT_DATA__"', 'type="application/ld+json"', 'type="application/json"'
    df = parsed(make(
        json_page(state, '{"a": {"x": {"bed_count": 9}}, "b": {"Bed-Count": 3}, "c": {"room_type_category": "Private room in flat"}}'),
        json_page(linked, '[{"beds": 0}, "text", {"name": "Entire place by sea"}]', "2 queen beds"),
        json_page(plain, '{"beds": ', "5 beds · 2 bedrooms ·"),
        json_page(state, '{"beds": null, "k": {"beds": "4"}, "roomType": 5, "z": {"roomType": "Hotel"}}'),
        json_page(plain, '{"beds": {"n": 1}, "bedrooms": 2.0}'),
    ))
    counts = P.beds_bedrooms(FOUND, TEXT)
    assert one(df, counts["beds"]) == [9, 2, 5, None, None]
    assert one(df, counts["bedrooms"]) == [None, None, 2, None, 2]
    rooms = one(df, P.room_type_full(FOUND, TEXT, HTML, F.col("h2")))
    assert rooms == ["Private room", "Entire home/apt", None, None, None]


def test_room_type_fallbacks(make):
    df = parsed(make(
        page("<h2>About</h2><h2>Room in a villa</h2>"), page("<h2>Shared room near park</h2>"),
        page("<p>Entire home to rent</p>"), page("x" * 3000 + " private room"), page("nothing")))
    rooms = one(df, P.room_type_full(FOUND, TEXT, HTML, F.col("h2")))
    assert rooms == ["Private room", "Shared room", "Entire home/apt", "Private room", None]
    assert one(df, P.room_type_text(TEXT, F.lower("h1"))) == [
        None, "Shared Room", "Entire Home", "Private Room", None]


def test_whole_pages_are_read(make):
    """A phrase behind any number of characters counts."""
    far = "x " * 6000
    df = parsed(make(page(far + "several rooms and a desk for $77 in a hotel room, kitchen")))
    flags = P.page_flags(TEXT, P.amenity_text(HTML, TEXT))
    assert one(df, flags["multi"]) == one(df, flags["biz"]) == one(df, flags["kitchen"]) == [True]
    assert one(df, P.price_text(TEXT)) == [77]
    assert one(df, P.room_type_full(FOUND, TEXT, HTML, F.col("h2"))) == ["Hotel room"]


def test_amenity_rows_of_the_section_only(make):
    section = '<section data-section-id="AMENITIES_DEFAULT"><div role="listitem"><div>Wi-Fi<br>fast</div> here</div></section>'
    df = parsed(make(page('<div role="listitem">Help</div><p>wifi kitchen</p>'), page(section + "<p>kitchen</p>"),
                     page('<div data-testid="amenity-row">Garage<div>inner</div>tv</div><p>kitchen</p>'),
                     page(section.replace("Wi-Fi<br>fast", "").replace(" here", "") + "kitchen"), page("AMENITIES_DEFAULT kitchen")))
    assert one(df, H.amenity_rows("html")) == [None, "wi-fi fast here", "garage inner tv", None, None]
    flags = P.page_flags(TEXT, P.amenity_text(HTML, TEXT))
    assert one(df, flags["wifi"]) == [True, True, False, False, False]
    assert one(df, flags["kitchen"]) == [True, False, False, True, True]


def test_unreadable_json_costs_its_page_nothing_else(make):
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    shallow = '{"a":[' * 600 + '{"beds": 2}' + "]}" * 600
    script = '<script type="application/json">{}</script>'
    df = P.found_json(make(page(head=script.replace("{}", deep)), page(head=script.replace("{}", '{"beds": 3, "beds": 4}')),
                           page(head=script.replace("{}", shallow)), page(head=script.replace("{}", '{"beds": '))))
    assert [[f.beds for f in r.found] for r in df.orderBy("page_id").collect()] in ([[], [4], [2], []], [[None], [4], [2], []])
    assert one(df, H.json_count(H.page_json("html")))[1:] == [1, 1, 0]
    twice = make(page(head='<script id="__NEXT_DATA__">{"a": 1}</script><script id="__NEXT_DATA__">{"beds": 5}</script>'))
    assert [f.beds for f in P.found_json(twice).first().found] == [None, 5]


def test_entities_and_quotes(make):
    df = P.page_text(make(page("caf&eacute; &#8364;99 night &#x1F600; &amp;lt; &amp;#65; &lt;b&gt; &unknown; &#0; a&nbsp;b &apos;&quot;")))
    assert one(df, "page_text") == ["café €99 night \U0001f600 &lt; &#65; <b> &unknown; &#0; a b '\""]
    links = make(page("<a href='/rooms/1'>a</a><a class=x href=/rooms/2>b</a><a data-href='/rooms/9' href = \"/rooms/3?x\">c</a>"))
    assert {r.url[-1] for r in P.listing_urls(links).collect()} == {"1", "2", "3"}


def test_one_price_per_address(make):
    body = page('<h1>Loft</h1><p>entire home, 2 beds ·</p>')
    search = make(*[page(f'<a href="/rooms/7">a</a><span class="price">${p}</span>') for p in (90, 80)],
                  page('<a href="/rooms/7">a</a><div data-testid="price-availability-row"><div><span>$70 now</span></div></div>'))
    assert sorted(r.search_price for r in P.search_prices(search).collect()) == [70, 80, 90]
    rows = P.extract_listings(make(body), search=P.search_prices(search)).collect()
    assert [r.realSum for r in rows] == [90]


def test_coordinates(make):
    df = parsed(make(
        page(head='<script>{"lat": 0.0, "lng": 0.0, "latitude": 48.8, "longitude": -2.5}</script>'),
        page(head='<script>{"lat": 48.8}</script>'),
        page(head='<script>{"lat": 0.0, "lng": 9.0, "listing": {"lat": 41.5, "lng": 2.5}}</script>'),
        page('<div data="x">"lat": 40.5, "lng": 3.5</div>'), page(head='<script>{"lat": 1.2.3, "lng": 2}</script>')))
    got = [None if p is None else tuple(p) for p in one(df, P.page_coordinates(SCRIPTS, HTML))]
    assert got == [(48.8, -2.5), None, (41.5, 2.5), (40.5, 3.5), None]


def test_prices(make):
    df = parsed(make(
        page("<p>$1,234 per night</p>"), page("<p>€80 night</p>"), page(head='<script>{"priceString":"$95"}</script>'),
        page("<p>$3 per night</p>"), page("<p>$60000 night</p>"), page('<span class="a price">$77</span><p>$5,000 night</p>'),
        page("<p>120 € night</p>"), page("<p>from $42 today</p>")))
    assert one(df, P.price_full(HTML, SCRIPTS, TEXT)) == [1234, 80, 95, None, None, 77, 120, None]
    assert one(df, P.price_text(TEXT)) == [1234, 80, None, 3, 60000, 5000, None, 42]


def test_reviews_and_ratings(make):
    df = parsed(make(
        page('<span aria-label="4.87 rating">x</span>1,204 reviews'), page("rated 9.1 then rating: 4.5"),
        page("★ 4.5 and cleanliness: 4.9"), page("cleanliness: 9"), page("none")))
    r = P.page_ratings(HTML, TEXT)
    assert one(df, r["guest_satisfaction_overall"]) == [4.87, 4.5, 4.5, None, None]
    assert one(df, r["cleanliness_rating"]) == [None, None, 4.9, None, None]
    assert one(df, P.review_count(TEXT)) == [1204, None, None, None, None]


def test_flags_and_strict_words(make):
    df = parsed(make(page("a nice place"), page("Superhost, several rooms, workspace, A/C, hdtv, wi-fi"),
                     page(
                         '<div data-section-id="AMENITIES_DEFAULT"><div role="listitem"><div>Kitchen</div> big</div></div><p>wifi</p>')))
    loose, strict = P.page_flags(TEXT), P.page_flags(TEXT, strict_words=True)
    assert one(df, loose["air_conditioning"]) == [True, True, False]
    assert one(df, strict["air_conditioning"]) == [False, True, False]
    for flag in ("host_is_superhost", "multi", "biz", "tv", "wifi"):
        assert one(df, loose[flag])[1] is True, flag
    listed = P.page_flags(TEXT, P.amenity_text(HTML, TEXT))
    assert (one(df, listed["kitchen"])[2], one(df, listed["wifi"])[2]) == (True, False)


def test_weekend_stay(spark):
    df = spark.createDataFrame([("2026-01-26",), ("2026-01-30",), ("2026-01-31",)], "d string")
    got = df.select(*[c.cast("string").alias(n) for n, c in P.weekend_stay(F.to_date("d")).items()]).collect()
    assert [tuple(r) for r in got] == [("2026-01-30", "2026-02-01"), ("2026-02-06", "2026-02-08"), ("2026-02-06", "2026-02-08")]
    assert spark.range(1).select(P.per_night(F.lit(300))).first()[0] == 150.0


def test_records(make, spark):
    df = make(page("<p>3 beds · private room $90 night</p>"), page("<p>nothing here</p>"), page(title="oops"),
              ("https://stay.example.com/rooms/8", page("<p>shared room</p>")))
    search = spark.createDataFrame([("https://stay.example.com/rooms/8", 55)], "url string, search_price int")
    got = {r.listing_key: r for r in P.extract_listings(df, search=search).collect()}
    assert set(got) == {"7", "8"}
    assert (got["7"].realSum, got["7"].beds, got["7"].room_private, got["7"].city) == (90, 3, True, "Paris")
    assert (got["8"].realSum, got["8"].room_shared) == (55, True)
    assert [c for c in P.extract_listings(df).columns if c in C.CITY_FILE_COLUMNS] == list(C.CITY_FILE_COLUMNS)


# --- streaming ------------------------------------------------------------------
def city_rows(spark, rows):
    fields = {c: "cast(null as string)" for c in C.CITY_FILE_COLUMNS}
    df = spark.createDataFrame(rows, "url string, city string, realSum int")
    return df.select(*[c if c in df.columns else F.expr(fields[c]).alias(c) for c in C.CITY_FILE_COLUMNS])


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / d) for d in ("in", "out", "cp"))
    O.write_by_city(city_rows(spark, [("u1", "paris", 1), ("u2", "paris", 2), ("u2", "paris", 2)]), inbox + "/1")
    T.ingest_city_files(spark, inbox, out, progress, files_per_batch=1).awaitTermination()
    O.write_by_city(city_rows(spark, [("u2", "paris", 3), ("u3", "rome", 4)]), inbox + "/2")
    T.ingest_city_files(spark, inbox, out, progress, files_per_batch=1).awaitTermination()
    T.ingest_city_files(spark, inbox, out, progress).awaitTermination()
    got = T.read_city_table(spark, out)
    assert sorted((r.url, r.city, r.realSum) for r in got.collect()) == [
        ("u1", "paris", 1), ("u2", "paris", 2), ("u3", "rome", 4)]
    batch = T.batch_city_files(spark, inbox)
    assert sorted(map(str, batch.select(sorted(batch.columns)).collect())) == sorted(
        map(str, got.select(sorted(batch.columns)).collect()))


def test_batches_read_their_buckets_and_keep_rows_without_address(spark, tmp_path):
    inbox, out, progress, rest = (str(tmp_path / d) for d in ("in", "out", "cp", "rest"))
    O.write_by_city(city_rows(spark, [(f"u{i}", "paris", i) for i in range(50)] + [(None, "rome", 1)]), inbox + "/1")
    T.ingest_city_files(spark, inbox, out, progress, no_address_dir=rest).awaitTermination()
    O.write_by_city(city_rows(spark, [("u7", "paris", 9), ("v", None, 1)]), inbox + "/2")
    T.ingest_city_files(spark, inbox, out, progress, no_address_dir=rest).awaitTermination()
    got = T.read_city_table(spark, out)
    assert got.count() == 51 and got.filter("url = 'u7'").first().realSum == 7
    assert got.columns == [f.name for f in T.schemas.CITY_FILE.fields]
    assert spark.read.parquet(rest).filter("city = 'rome'").count() == 1


def test_repeated_batch_adds_nothing(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    O.write_by_city(city_rows(spark, [("u1", "paris", 1)]), inbox)
    for progress in ("cp1", "cp2"):  # a lost checkpoint replays the files
        T.ingest_city_files(spark, inbox, out, str(tmp_path / progress)).awaitTermination()
    assert T.read_city_table(spark, out).count() == 1


def test_keyed_stream_equals_batch(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / d) for d in ("in", "out", "cp"))
    O.write_by_city(city_rows(spark, [("u1", "paris", 1), ("u2", "paris", 2), ("u2", "paris", 2)]), inbox + "/1")
    T.ingest_city_files_keyed(spark, inbox, out, progress, files_per_batch=1).awaitTermination()
    O.write_by_city(city_rows(spark, [("u2", "paris", 3), ("u3", "rome", 4)]), inbox + "/2")
    T.ingest_city_files_keyed(spark, inbox, out, progress, files_per_batch=1).awaitTermination()
    got = T.read_city_table(spark, out)
    batch = T.batch_city_files(spark, inbox)
    assert sorted(map(str, batch.select(sorted(batch.columns)).collect())) == sorted(
        map(str, got.select(sorted(batch.columns)).collect()))


def test_keyed_known_addresses_and_rows_without_address(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / d) for d in ("in", "out", "cp"))
    O.write_by_city(city_rows(spark, [(f"u{i}", "paris", i) for i in range(50)] + [(None, "rome", 1)]), inbox + "/1")
    T.ingest_city_files_keyed(spark, inbox, out, progress).awaitTermination()
    O.write_by_city(city_rows(spark, [("u7", "paris", 9), ("v", None, 1), (None, "rome", 2)]), inbox + "/2")
    T.ingest_city_files_keyed(spark, inbox, out, progress).awaitTermination()
    got = T.read_city_table(spark, out)
    assert got.count() == 53 and got.filter("url = 'u7'").first().realSum == 7
    assert got.filter("url is null").count() == 2
    assert got.columns == [f.name for f in T.schemas.CITY_FILE.fields]


def test_keyed_repeated_batch_adds_nothing(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    O.write_by_city(city_rows(spark, [("u1", "paris", 1)]), inbox)
    for progress in ("cp1", "cp2"):  # a lost checkpoint replays the files; the table seeds the new state
        T.ingest_city_files_keyed(spark, inbox, out, str(tmp_path / progress)).awaitTermination()
    O.write_by_city(city_rows(spark, [("u1", "paris", 5), ("u2", "rome", 6)]), inbox + "/later")
    T.ingest_city_files_keyed(spark, inbox, out, str(tmp_path / "cp3")).awaitTermination()
    assert sorted((r.url, r.realSum) for r in T.read_city_table(spark, out).collect()) == [("u1", 1), ("u2", 6)]


# --- price model ----------------------------------------------------------------
@pytest.fixture(scope="module")
def priced(spark):
    rows = [(i, ("paris", "rome")[i % 2], ("flat", "room")[i % 3 == 0], 1 + i % 5, (i % 50) / 10.0, float(i % 8), i % 2,
             100.0 * (1 + i % 5) + 20 * (i % 2)) for i in range(400)]
    return spark.createDataFrame(rows, "listing_id long, city string, room_type string, person_capacity int,"
                                 " cleanliness_rating double, dist double, is_weekend int, realSum double")


def test_model_learns_and_scores(spark, priced):
    train, test = M.split_holdout(priced)
    assert train.count() + test.count() == 400 and 40 < test.count() < 120
    model = M.train_price_model(train, trees=10)
    scores = M.evaluate(model, test).first()
    assert scores.r2 > 0.95 and scores.rmse < 40 and scores.n == test.count()
    unseen = priced.limit(1).withColumn("city", F.lit("oslo"))
    assert M.predict_price(model, unseen).first().predicted_price > 0
    scenarios = spark.createDataFrame([(1, "paris", 1), (2, "paris", 5), (3, "rome", None)],
                                      "scenario_id int, city string, person_capacity int")
    got = {r.scenario_id: r for r in M.what_if(model, priced, scenarios).collect()}
    assert got[1].predicted_price < 200 < 400 < got[2].predicted_price
    assert got[3].person_capacity == M.base_rows(priced).filter("city = 'rome'").first().person_capacity


ROUGH = ("listing_id long, city string, room_type string, person_capacity int, cleanliness_rating double, dist double,"
         " is_weekend int, realSum double")


def fitted_rows(monkeypatch):
    """The number of rows that the trees are grown on, once for each fit."""
    seen, fit = [], M.GBTRegressor._fit
    monkeypatch.setattr(M.GBTRegressor, "_fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    return seen


def test_trees_are_grown_on_cells_with_the_result_of_rows(spark, monkeypatch):
    rows = [(i, (None, "paris", "rome")[i % 7 % 3], ("flat", "room")[i % 3 == 0], None if i % 11 == 0 else 1 + i % 5,
             (i * i % 4) / 2.0, float(i % 8), i % 2, None if i % 97 == 0 else 50.0 + (i * 37 % 101) + 40 * (i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, ROUGH).unionAll(spark.createDataFrame(rows[:700], ROUGH))
    seen = fitted_rows(monkeypatch)
    model = M.train_price_model(df, trees=5, depth=4)
    known = M.features(df, ["realSum"]).dropna(subset=["realSum"]).withColumn("log_price", F.log1p("realSum"))
    assert seen == [known.select(*M.FEATURES).distinct().count()] and 2 * seen[0] < known.count()
    plain = M.Pipeline(stages=[
        M.StringIndexer(inputCols=list(M.CATEGORIES), outputCols=["a", "b"], handleInvalid="keep", stringOrderType="alphabetAsc"),
        M.VectorAssembler(inputCols=["a", "b", *M.NUMBERS], outputCol="features"),
        M.GBTRegressor(featuresCol="features", labelCol="log_price", predictionCol="log_predicted", maxIter=5, maxDepth=4,
                       seed=42, maxBins=64)]).fit(known)
    want, got = ({r.listing_id: r.predicted_price for r in M.predict_price(m, df).select("listing_id", "predicted_price").collect()}
                 for m in (plain, model))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * want[k] for k in want)


def test_numbers_of_many_values_enter_by_bucket(spark, monkeypatch):
    # dist: a third missing, a third 0, the rest all different; the price depends on it alone
    rows = [(i, "paris", "flat", 2, 5.0, (None, 0.0, 1 + i / 1000)[i % 3], 0,
             (900.0, 400.0, 100.0 if i < 4500 else 200.0)[i % 3]) for i in range(9000)]
    df = spark.createDataFrame(rows, ROUGH)
    seen = fitted_rows(monkeypatch)
    model = M.train_price_model(df, trees=3)
    assert len(seen) == 1 and 10 < seen[0] <= 128  # one or two cells for each bin, not 3,002 for the values
    scored = M.predict_price(model, df)
    assert scored.columns == [*M.FEATURES, "listing_id", "realSum", "predicted_price"]
    wrong = [r for r in scored.collect() if abs(r.predicted_price - r.realSum) > 0.02 * r.realSum]
    assert all(r.dist > 1 and abs(r.dist - 5.5) < 0.3 for r in wrong)  # only in the bucket of the step


def test_few_cells_of_many_rows(spark, priced):
    same = priced.filter("listing_id < 1").select("listing_id", *M.FEATURES)
    df = same.crossJoin(spark.createDataFrame([(90.0,), (110.0,), (100.0,)], "realSum double"))
    cells = M.training_cells(M.features(df, ["realSum"]).withColumn("log_price", F.log1p("realSum")), M.FEATURES, 64)
    assert sorted(r.n_rows for r in cells.collect()) == [1, 2]
    got = M.predict_price(M.train_price_model(df, trees=2), df).collect()
    assert len(got) == 3 and all(abs(r.predicted_price - (91 * 101 * 111) ** (1 / 3) + 1) < 1e-6 for r in got)


def test_price_without_logarithm_is_refused(spark, priced):
    bad = priced.withColumn("realSum", F.when(F.col("listing_id") == 7, -1.0).otherwise(F.col("realSum")))
    with pytest.raises(Exception, match="(?i)label"):
        M.train_price_model(bad, trees=1)


def test_every_row_is_scored_also_outside_the_buckets(spark, monkeypatch):
    rows = [(i, "paris", "flat", 2, 5.0, 1 + i / 1000, 0, 100.0 if i < 1000 else 200.0) for i in range(2000)]
    seen = fitted_rows(monkeypatch)
    model = M.train_price_model(spark.createDataFrame(rows, ROUGH), trees=3)
    assert seen[0] <= 128
    asked = [(1, "paris", -7.0), (2, "paris", 1e9), (2, "paris", 1e9), (3, "oslo", None), (4, None, 1.1)]
    df = spark.createDataFrame(asked, "listing_id long, city string, dist double").select(
        "listing_id", "city", F.lit("flat").alias("room_type"), F.lit(2).alias("person_capacity"),
        F.lit(5.0).alias("cleanliness_rating"), "dist", F.lit(0).alias("is_weekend"))
    got = sorted((r.listing_id, round(r.predicted_price, -1)) for r in M.predict_price(model, df).collect())
    assert got == [(1, 100), (2, 200), (2, 200), (3, 100), (4, 100)]
