"""Margins learned from training documents: what is written in a language without training rows goes, the rest stays."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kpiscope.llm import language
from kpiscope.llm.shared import load

UNLEARNED = {
    "fi": "Kun aurinko laski järven taakse, vanha kalastaja veti veneensä rantaan ja sytytti pienen nuotion. Hän oli odottanut tätä iltaa koko pitkän kesän, sillä hänen poikansa oli luvannut palata kaupungista ennen syksyn ensimmäisiä pakkasia.",
    "pl": "Kiedy słońce zaszło za jeziorem, stary rybak wyciągnął łódź na brzeg i rozpalił małe ognisko. Czekał na ten wieczór przez całe długie lato, ponieważ jego syn obiecał wrócić z miasta przed pierwszymi jesiennymi przymrozkami.",
    "hu": "Amikor a nap lenyugodott a tó mögött, az öreg halász partra húzta a csónakját, és kis tüzet gyújtott. Egész nyáron erre az estére várt, mert a fia megígérte, hogy az első őszi fagyok előtt hazatér a városból.",
    "tr": "Güneş gölün arkasında battığında yaşlı balıkçı teknesini kıyıya çekti ve küçük bir ateş yaktı. Bütün uzun yaz boyunca bu akşamı beklemişti, çünkü oğlu sonbaharın ilk donlarından önce şehirden döneceğine söz vermişti.",
}


@pytest.fixture(scope="module")
def learned(spark, sf):
    return language.fit(load(spark, sf, "documents").select("doc_id", "text", "lang"))


def test_unlearned_languages_are_rejected(spark, docs_of, learned):
    rows = [*enumerate(UNLEARNED.values()), *((10 + k, f"{t} " * 20) for k, t in enumerate(UNLEARNED.values()))]
    got = language.predict(docs_of(rows), learned).collect()
    assert {r["doc_id"]: r["rejected"] for r in got} == dict.fromkeys([i for i, _ in rows], True)


def test_documents_in_learned_languages_stay(spark, sf, learned):
    docs = load(spark, sf, "documents").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    assert language.predict(docs, learned).filter("lang = lang_pred and rejected").isEmpty()


def test_narrow_is_a_share_of_the_usual_margin():
    model = {"a": b"\n".join([b"the and of that is with from this " * 4] * 4), "b": b"\n".join([b"und der die das ist mit von dem " * 4] * 4), "c": b"only one sample"}
    least = language.least_margins(model)
    assert least["a"] > language.LEAST_MARGIN and least["b"] > language.LEAST_MARGIN and least["c"] == min(least["a"], least["b"])
    assert language.least_margins({"a": b"x"}) == {"a": language.LEAST_MARGIN} and language.least_margins({}) == {}
