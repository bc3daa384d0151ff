"""CSV files by path and by folder, and folders of any names."""

import os

from heronry.sources import readers


def test_read_table_equals_the_folder_path(spark, tmp_path):
    os.makedirs(f"{tmp_path}/d[1]")
    cases = {
        "quotes.csv": b'a,b\n"x ""y"" z",1\n"two\nlines",2\n"c, d",3\n', "latin.csv": "näme,b\ncafé,1\n".encode("latin-1"), "ragged.csv": b"a,b,\n1\n1,2,3,4,5\n,,\n\n 7 , 8\n",
        "tab.tsv": b"a\tb\n1,5\t2\n", "{x}.csv": b"h\n1\n2\n", "long.csv": b"n,m\n" + b"".join(b"%d,x\n" % i for i in range(95)),
    }
    for name, content in cases.items():
        with open(f"{tmp_path}/d[1]/{name}", "wb") as f:
            f.write(content)
    kind, docs = readers.resolve(spark, f"{tmp_path}/d[1]")
    by_folder = {r["url"].rsplit("/", 1)[1]: r for r in docs.collect()}
    assert kind == "directory" and set(by_folder) == set(cases)
    for name in cases:
        assert readers.read_table(spark, f"{tmp_path}/d[1]/{name}").first()["text"] == by_folder[name]["text"], name
    assert 'x "y" z' in by_folder["quotes.csv"]["text"] and "café" in by_folder["latin.csv"]["text"] and "## Rows 91–95" in by_folder["long.csv"]["text"]


def test_names_with_pattern_characters(spark, tmp_path):
    os.makedirs(f"{tmp_path}/x/build")
    for name in ("a{1}.txt", "b[2].txt", "c*.txt", "d?.txt", "build/e.txt", "f.bin"):
        with open(f"{tmp_path}/x/{name}", "w") as f:
            f.write("text of " + name)
    docs = readers.resolve(spark, f"{tmp_path}/x")[1].collect()
    assert sorted(r["text"].rsplit(" ", 1)[1] for r in docs) == ["a{1}.txt", "b[2].txt", "c*.txt", "d?.txt"]
    assert readers.resolve(spark, f"{tmp_path}/x/a{{1}}.txt")[1].count() == 1
