from collections import Counter

from textshield.llm import urls


def test_words_of_all_pages_count(spark):
    rows = [(i, f"https://a{'bcd'[i % 3]}.com/green{'house' if i % 2 else 'field'}", f"<p>common {'green house' if i == 4500 else 'x' * (i % 30 + 1)}</p>") for i in range(5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    words = Counter(w for _, _, h in rows for w in h[3:-4].split())
    whole = urls.Segmenter(words)
    got = urls.learn_words(df)
    assert sum(got.values()) == sum(words.values()) and got["green"] == got["house"] == 1 and "common" not in got
    for run in ("greenhouse", "greenfield", "ab", "com"):
        assert urls.Segmenter(got).split(run) == whole.split(run)
