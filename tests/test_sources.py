import pytest
from pyspark.sql import functions as F

from linkaudit.operators import recommend as M
from linkaudit.sources import attributes, sinks, sitemap
from linkaudit.sources.csv import _opens_a_field, canonical_links, file_forms, map_link_columns, read_csv, read_links_csv, read_url_table, sniff_separator

HEAD = ["Source", "Destination", "Ancrage", "Origine du lien", "Chemin du lien"]
ROW = ["https://s.fr/é", "https://s.fr/b", "forêt dense", "Contenu", "/p/a"]


def write(tmp_path, data: bytes, name="links.csv"):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_separators_and_encodings(spark, tmp_path, sep, encoding):
    data = "\r\n".join(sep.join(r) for r in (HEAD, ROW, ROW)) + "\r\n"
    rows = read_links_csv(spark, write(tmp_path, data.encode(encoding))).collect()
    assert [tuple(r)[:5] for r in rows] == [tuple(ROW)] * 2


def test_late_latin1_byte_is_found(spark, tmp_path):
    data = ",".join(HEAD) + "\n" + ("https://s.fr/a,https://s.fr/b,x,y,z\n" * 5000) + ",".join(ROW) + "\n"
    rows = read_links_csv(spark, write(tmp_path, data.encode("latin-1")))
    assert rows.where("anchor = 'forêt dense'").count() == 1


def test_quoted_line_break_missing_cells_and_quotes(spark, tmp_path):
    data = 'Source,Destination,Ancrage\n"https://s.fr/a",https://s.fr/b,"deux\nlignes"\nhttps://s.fr/a,https://s.fr/c\nu,v,"dit ""oui"""\n'
    rows = {r.destination: r.anchor for r in read_links_csv(spark, write(tmp_path, data.encode())).collect()}
    assert rows == {"https://s.fr/b": "deux\nlignes", "https://s.fr/c": "", "v": 'dit "oui"'}


def test_empty_file_and_header_only(spark, tmp_path):
    assert read_csv(spark, write(tmp_path, b"")).columns == []
    assert read_links_csv(spark, write(tmp_path, ",".join(HEAD).encode() + b"\n", "h.csv")).count() == 0
    with pytest.raises(ValueError):
        canonical_links(read_csv(spark, write(tmp_path, b"a,b\n1,2\n", "x.csv")))


def test_each_file_of_a_folder_is_read_in_its_own_form(spark, tmp_path):
    folder = tmp_path / "all outlinks"
    folder.mkdir()
    swapped = [1, 0, 2, 3, 4]
    (folder / "a.csv").write_bytes(("\n".join(",".join(r) for r in (HEAD, ROW)) + "\n").encode())
    (folder / "b é.csv").write_bytes(("\n".join(";".join(r) for r in (HEAD, ROW)) + "\n").encode("latin-1"))
    (folder / "c.csv").write_bytes(("\n".join("\t".join(r[i] for i in swapped) for r in (HEAD, ROW)) + "\n").encode())
    (folder / "d.csv").write_bytes((",".join(HEAD) + "\n" + ROW[0] + "," + ROW[1] + ',"forêt\ndense",Contenu,/p/a\n').encode())
    (folder / "empty.csv").write_bytes(b"")
    rows = [tuple(r)[:5] for r in read_links_csv(spark, str(folder)).collect()]
    assert sorted(rows) == sorted([tuple(ROW)] * 3 + [(ROW[0], ROW[1], "forêt\ndense", "Contenu", "/p/a")])


@pytest.mark.parametrize(
    "line, expected",
    [(b'a,27" plat,c', False), (b'a,"27"" plat",c', False), (b'a,"open', True), (b'"open,b', True), (b'a,"x","y', True), (b'a,b"', False), (b'a,"",c', False)],
)
def test_only_fields_that_run_over_a_line_end_make_a_file_whole(spark, tmp_path, line, expected):
    data = b"Source,Destination,Ancrage\n" + line + b'\n' + (b'end",x\n' if expected else b"")
    forms = file_forms(spark, write(tmp_path, data))
    assert [f.multi_line for f in forms] == [expected]


@pytest.mark.parametrize(
    "before, after",
    [
        ("", ""),
        (",".join(f"column {i}" for i in range(400)) + ",", "," * 400),
        ("\n", ""),
        (" \n" * 60, ""),
        ('"Link\n', '"x\n'),
    ],
)
def test_files_meet_under_whole_headers_only(spark, tmp_path, before, after):
    closing = '"' if before.startswith('"') else ""
    folder = tmp_path / "links"
    folder.mkdir()
    for name, columns, row in (("a.csv", ("Source", "Destination"), ("s", "d")), ("b.csv", ("Destination", "Source"), ("d", "s"))):
        (folder / name).write_text(f"{before}{columns[0]}{closing},{columns[1]}\n{after}{row[0]}{closing},{row[1]}\n")
    rows = [(r.source[-1], r.destination[-1]) for r in read_links_csv(spark, str(folder)).collect()]
    assert rows == [("s", "d")] * 2


def test_blank_header_keeps_the_columns_in_place(spark, tmp_path):
    data = " Source ,,Destination\na,x,b\n"
    row = read_links_csv(spark, write(tmp_path, data.encode())).first()
    assert (row.source, row.destination) == ("a", "b")


def test_column_roles():
    french = ["Type", "Source", "Destination", "Texte Alt", "Ancrage", "Chemin du lien", "Origine du lien"]
    roles = map_link_columns(french)
    assert (roles["anchor"], roles["origin"], roles["path"]) == ("Ancrage", "Origine du lien", "Chemin du lien")
    english = ["Link Type", "Source", "Target", "Alt Text", "Anchor", "Link Path", "Link Origin"]
    roles = map_link_columns(english)
    assert (roles["destination"], roles["anchor"], roles["path"], roles["link_type"]) == ("Target", "Anchor", "Link Path", "Link Type")
    assert map_link_columns(["source", "dest", "link text"])["anchor"] == "link text"


def test_simple_separator():
    assert sniff_separator("a;b;c,d") == ";"
    assert sniff_separator("a;b;c,d", simple=True) == ","
    assert sniff_separator("a\tb", simple=True) == "\t"


def test_rows_keep_their_file_order(spark, tmp_path):
    lines = "".join(f"https://s.fr/{i % 7},t{i}\n" for i in range(20000))
    path = write(tmp_path, ("Address,Title 1\n" + lines).encode(), "page_titles.csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        table = read_url_table(spark, path, {"value": ("title",)}, with_order=True)
        assert table.select(F.spark_partition_id()).distinct().count() > 1
        last = attributes.load_page_attributes(table.withColumn("attr", F.lit("titles")))
        got = {r.url: r.titles for r in last.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"https://s.fr/{k}": f"t{max(i for i in range(20000) if i % 7 == k)}" for k in range(7)}


def test_attribute_files(spark, tmp_path):
    links = write(tmp_path, b"Source,Destination\na,b\n", "liens.csv")
    write(tmp_path, b"Address,Title 1\nu,Titre\nu,Titre neuf\nv,\n", "liens_titles.csv")
    write(tmp_path, b"Address,H1-1\nu,Tete\n", "all_h1.csv")
    files = attributes.attribute_files(spark, links)
    assert set(files) == {"titles", "h1"}
    row = attributes.load_page_attributes(attributes.read_page_attributes(spark, files)).collect()
    assert [(r.url, r.titles, r.h1, r.h2) for r in row] == [("u", "Titre neuf", "Tete", None)]
    assert [tuple(r) for r in attributes.page_text(attributes.load_page_attributes(attributes.read_page_attributes(spark, files))).collect()] == [("u", "Titre neuf Tete")]
    found = attributes.find_files(spark, str(tmp_path), {"page_titles": ("titles",), "word_count": ("word_count",)})
    assert set(found) == {"page_titles"}


def test_sitemap_cycles_and_namespaces(spark):
    docs = spark.createDataFrame(
        [
            ("r", '<sm:sitemapindex xmlns:sm="x"><sm:sitemap><sm:loc> i </sm:loc></sm:sitemap><sm:sitemap><sm:loc>r</sm:loc></sm:sitemap></sm:sitemapindex>'),
            ("i", "<sitemapindex><sitemap><loc>r</loc></sitemap><sitemap><loc>s</loc></sitemap><sitemap><loc>gone</loc></sitemap></sitemapindex>"),
            ("s", "<urlset>\n<url>\n<loc>\nhttps://s.fr/1\n</loc><image><loc>https://img</loc></image></url><url><loc>nope</loc></url></urlset>"),
            ("t", "<urlset><url><loc>https://s.fr/2</loc></url></urlset>"),
        ],
        "sitemap_url string, xml string",
    )
    reached = sitemap.expand_sitemap_index(docs, docs.where("sitemap_url = 'r'"))
    assert {tuple(r) for r in reached.collect()} == {("r", 0), ("i", 1), ("s", 2)}
    assert [r.url for r in sitemap.sitemap_pages(docs, docs.where("sitemap_url = 'r'")).collect()] == ["https://s.fr/1"]


def test_sitemap_files(spark, tmp_path):
    write(tmp_path, b'<?xml version="1.0"?><urlset><url><loc> https://s.fr/1 </loc></url><url><loc>x</loc></url></urlset>', "s.xml")
    assert [r.url for r in sitemap.read_sitemap_files(spark, str(tmp_path / "s.xml")).collect()] == ["https://s.fr/1"]


def test_sinks(spark, tmp_path, links_of):
    table = spark.createDataFrame([("a", 'il dit "oui", non', "")], "kind string, problem string, url string")
    sinks.write_recommendations(table, str(tmp_path / "r"))
    assert tuple(read_csv(spark, str(tmp_path / "r")).first()) == ("a", 'il dit "oui", non', "")
    sinks.write_tables({"t": table}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/t")).count() == 1
    assert M.COLUMNS[0] == "kind"


def test_the_driver_gets_a_bounded_row_for_each_file(spark, tmp_path, monkeypatch):
    """Long headers, many lines and several parts of a file: counts, flags and a digest come back, and one row a file."""
    import linkaudit.sources.csv as source

    rows = []
    old = source.separator_of
    monkeypatch.setattr(source, "separator_of", lambda *counts: rows.append(counts) or old(*counts))
    found = []
    form = source.FileForm
    monkeypatch.setattr(source, "FileForm", lambda *values: found.append(values) or form(*values))
    header = "Source;Destination;" + ";".join(f"column {i}" for i in range(3000))
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(header + "\n" + "\n".join(f"s{i};d{i}{',' * 40}" for i in range(5000)))
    (tmp_path / "blank.csv").write_text("\n \n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        forms = file_forms(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(f.sep, len(files)) for f, files in forms.items()] == [(";", 2)]
    assert len(rows) == len(found) == 2
    assert all(len(str(v)) <= 64 or "csv" in str(v) for values in [*rows, *found] for v in values)


def test_separator_counts_lines_after_the_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\n\nA\n1;2\n" + "3;4\n" * 10)
    assert [f.sep for f in file_forms(spark, str(tmp_path))] == [";"]


def test_deep_sitemap_indexes_write_each_sitemap_once(spark, tmp_path, monkeypatch):
    """Thirty indexes in a chain, each with two sitemaps, that end in a circle."""
    import linkaudit.sources.sitemap as sitemap

    monkeypatch.setattr(sitemap, "checkpoint_dir", lambda spark: str(tmp_path))
    index = "<sitemapindex>{}</sitemapindex>".format
    entry = "<sitemap><loc>{}</loc></sitemap>".format
    rows = [(f"i{k}", index(entry(f"i{(k + 1) % 31}") + entry(f"s{k}a") + entry(f"s{k}b") + entry("missing"))) for k in range(31)]
    rows += [(f"s{k}{c}", f"<urlset><url><loc>http://x/{k}{c}</loc></url></urlset>") for k in range(31) for c in "ab"]
    documents = spark.createDataFrame(rows, "sitemap_url string, xml string").coalesce(2)
    reached = sitemap.expand_sitemap_index(documents, documents.where("sitemap_url = 'i0'"))
    depths = {r.sitemap_url: r.depth for r in reached.collect()}
    assert depths == {**{f"i{k}": k for k in range(31)}, **{f"s{k}{c}": k + 1 for k in range(31) for c in "ab"}}
    # what is written is a row for each sitemap, not one for each level
    folder = next(p for p in tmp_path.iterdir() if p.name.startswith("sitemaps-"))
    assert spark.read.schema("sitemap_url string").parquet(str(folder)).count() == 93


def test_sitemap_files_with_prefixes_and_compression(spark, tmp_path):
    import gzip

    from linkaudit.sources.sitemap import read_sitemap_files

    body = '<?xml version="1.0"?>\n<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9">{}</sm:urlset>'
    body = body.format("".join(f"<sm:url><sm:loc> http://x/{i} </sm:loc><sm:priority>1</sm:priority></sm:url>" for i in range(3)))
    with gzip.open(tmp_path / "a.xml.gz", "wt") as f:
        f.write(body)
    assert sorted(r.url for r in read_sitemap_files(spark, str(tmp_path)).collect()) == ["http://x/0", "http://x/1", "http://x/2"]


def test_lines_without_quotes_are_not_searched_for_open_fields(spark):
    lines = spark.createDataFrame([("a,b",), ('a,"b',), ('"a","b"',), ('a,"b""',), ("",)], "value string")
    searched = lines.select(_opens_a_field(",").alias("open"))
    assert [r.open for r in searched.collect()] == [False, True, False, True, False]
    assert "contains" in searched._jdf.queryExecution().analyzed().toString().lower()
