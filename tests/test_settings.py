import pytest

from sparkseek.functions.register import register
from sparkseek.plans.settings import SavedSearch, Settings, capture_address, load, plain_terms, save, saved_name


def test_settings_file(tmp_path):
    path = str(tmp_path / "x/settings.json")
    assert load(path) == Settings()
    new = Settings().merged({"folders": ["/a"], "theme": "dark", "odd": 1, "saved_searches": [{"id": "1", "name": "n", "query": "q"}]})
    save(path, new)
    assert load(path) == new and new.saved_searches[0].request().q == "q" and not (tmp_path / "x/settings.json.pending").exists()
    for bad in ({"theme": "pink"}, {"scope": "x"}, {"saved_searches": [SavedSearch("1", "x" * 129, "q")]}, {"saved_searches": [SavedSearch("1", "n", "q", "odd")]}):
        with pytest.raises(ValueError):
            Settings().merged(bad)


def test_names_terms_and_addresses():
    assert saved_name(" a ") == "a" and saved_name("é" * 100) == "é" * 62 + "…"
    assert plain_terms('red "dog" -cat tag:"x y" ext:png') == "red dog"
    assert capture_address("https://u:p@h.org/a?b=1#c") == "https://h.org/a?b=1"
    with pytest.raises(ValueError):
        capture_address("file:///x")


def test_registered_functions(spark):
    assert set(register(spark)) == {"fold", "ascii_lower", "hash_distance", "word_list", "has_word", "quantise", "color_name", "osa_distance", "words"}
    row = spark.sql("SELECT fold('Inv0ice') AS f, ascii_lower('AÉ') AS a, hash_distance('ff', '0') AS h, word_list('An écran, x2y') AS w, osa_distance('teh', 'the') AS d").first()
    assert tuple(row) == ("lnvolce", "aÉ", 8, ["écran", "x2y"], 1)
    assert [r["word"] for r in spark.sql("SELECT * FROM words('An Écran, x2y_abc')").collect()] == ["écran", "x2y", "abc"]
