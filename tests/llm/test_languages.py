import numpy as np
import pytest

from trailmill.llm import languages as L


def test_labels():
    same = {"en": ["EN", "en-US", "en_GB", "eng", "English", " english "], "zh": ["zh-Hans", "zh_TW", "zho", "chi", "Chinese"], "de": ["de-AT", "deu", "ger", "German"], "ja": ["ja-JP", "jpn", "JAPANESE"]}
    assert all(L.label(x) == k for k, names in same.items() for x in names)
    assert [L.label(x) for x in ("nl", "und", "", None, "unknown", "n/a", "xx-en")] == [None] * 7


def test_sentences_leave_out_what_is_no_prose():
    text = (
        "# A heading. With stops. And more.\n\nThe parser reads `foo. bar baz.` from src/a/b.py and works. It said \"no such file or directory.\" twice today!\n"
        "```\nthis is some code. it has sentences too.\n```\n12:00:01 INFO The worker has been started now.\nfor x in self.items:\n  return a.b.c\n- A list item is prose.\nTraceback (most recent call last):\n  File \"x.py\", line 3. in here too.\n"
        "日本語の文章です。短い。\r\nUnfinished line without a stop\nuser: This is a chat line.\n"
    )
    got = [s for _, _, s in L.sentences(text)]
    assert len(got) == 5 and got[0].startswith("the parser reads") and got[2] == "a list item is prose." and got[3] == "日本語の文章です。" and got[4] == "this is a chat line."
    assert all(text[a:b].strip()[-1] in ".!。" for a, b, _ in L.sentences(text))
    assert L.sentences("") == [] and L.sentences("\0\0 &amp; &#233; x") == [] and L.sentences("word " * 100_000) == []
    assert len(L.sentences("caf&eacute;s are very nice. " * 20_000)) == 20_000


CORPUS = {
    "en": ["The worker writes the same record twice before the first answer arrives.", "Please run the whole suite again and attach the output.", "This change should not take long to review."],
    "de": ["Der Arbeitsprozess schreibt denselben Datensatz zweimal, bevor die erste Antwort kommt.", "Bitte den ganzen Lauf wiederholen und die Ausgabe anhängen.", "Diese Änderung sollte schnell geprüft sein."],
    "fr": ["Le processus écrit deux fois le même enregistrement avant la première réponse.", "Merci de relancer toute la suite et de joindre la sortie.", "Cette modification devrait être relue rapidement."],
    "ja": ["最初の応答が届く前に、同じ記録を二回書き込みます。", "テスト全体をもう一度実行して結果を添付してください。", "この変更の確認には時間がかかりません。"],
}


@pytest.fixture(scope="module")
def docs(spark):
    rows, i = [], 0
    for _ in range(12):
        for lang, s in CORPUS.items():
            rows.append((i, " ".join(s), lang, "x", 1))
            i += 1
    extra = [
        ("\n\n".join([" ".join(CORPUS["en"]), " ".join(CORPUS["de"])]), "en"), (" ".join(CORPUS["fr"]), None), (" ".join(CORPUS["fr"]), "de"), (" ".join(CORPUS["de"]), "German"), (" ".join(CORPUS["ja"]), "unknown"),
        (CORPUS["en"][0], "de"), (" ".join(CORPUS["en"]) + " " + CORPUS["de"][0], "en"), (None, "en"), ("", None), ("```\ncode. code. code.\n```", None), (" ".join(CORPUS["de"]).replace("ä", "a").replace("ü", "u").replace("Ä", "A"), "de-AT"), (" ".join(CORPUS["en"] * 3000), "zz"),
    ]
    rows += [(1000 + k, t, lang, "x", 1) for k, (t, lang) in enumerate(extra)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, label string, id int")


def test_cases(docs):
    out = L.identify(docs)
    got = sorted((r.doc_id, r.lang) for r in L.cases(out).collect())
    assert got == [(1000, "de"), (1000, "en"), (1001, "fr"), (1002, "fr"), (1004, "ja"), (1011, "en")]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == 60 and rows[1007].langs == [] and rows[1008].segments == [] and rows[1009].langs == []
    assert [s.lang for s in rows[1000].segments] == ["en", "de"] and abs(sum(x.share for x in rows[1000].langs) - 1) < 1e-6
    assert all(0.5 < x.confidence <= 1 for r in rows.values() for x in r.langs) and rows[1011].langs[0].sentences == 9000


def test_held_out_accuracy():
    train = [(s.lower(), k) for k, v in CORPUS.items() for s in v] * 5
    noisy = [(s, "en") if i % 17 == 0 else (s, k) for i, (s, k) in enumerate(train)]
    model, codes = L.fit([s for s, _ in noisy], [k for _, k in noisy])
    new = [("the process writes the record again.", "en"), ("der lauf schreibt die ausgabe zweimal.", "de"), ("la suite écrit la sortie deux fois.", "fr"), ("同じ結果をもう一度添付します。", "ja")]
    assert [codes[i] for i in L.likelihoods([s for s, _ in new], model).argmax(1)] == [k for _, k in new]


def test_mixture():
    logs = np.array([[0, -30, -60], [0, -2, -60], [-40, 0, -60], [0, -1.0, -50], [-0.5, 0, -50]], np.float32)
    share, post = L.mixtures(logs, np.array([0, 0, 0, 2, 3]), 4)
    assert share[0, 2] == 0 and share[0, 0] > share[0, 1] > 0.2 and share[1].sum() == 0 and (share[2] > 0).sum() == 1 and np.allclose(post.sum(1), 1)


def test_without_labels(spark, docs):
    none = docs.withColumn("lang", docs["label"])
    assert L.cases(L.identify(none)).count() == 0 and L.identify(docs.limit(0)).count() == 0


#: Prose of other subjects than those of the tables, written for this test.
PROSE = {
    "en": ["My grandmother keeps three hens behind the old barn.", "It rained all night, so the river had risen by the morning.", "She sold her bicycle because nobody ever fixed the brakes.", "There was hardly any bread left when we came home.", "Our neighbours sing in the choir every Thursday."],
    "de": ["Meine Großmutter hält drei Hühner hinter der alten Scheune.", "Es regnete die ganze Nacht, deshalb stieg der Fluss bis zum Morgen.", "Sie hat ihr Fahrrad verkauft, weil niemand die Bremsen reparierte.", "Als wir heimkamen, war kaum noch Brot da.", "Unsere Nachbarn singen jeden Donnerstag im Chor."],
    "fr": ["Ma grand-mère élève trois poules derrière la vieille grange.", "Il a plu toute la nuit, et la rivière avait monté au matin.", "Elle a vendu son vélo parce que personne ne réparait les freins.", "Il ne restait presque plus de pain quand nous sommes rentrés.", "Nos voisins chantent dans la chorale chaque jeudi."],
    "es": ["Mi abuela cría tres gallinas detrás del viejo granero.", "Llovió toda la noche y el río había crecido por la mañana.", "Vendió su bicicleta porque nadie arreglaba los frenos.", "Apenas quedaba pan cuando volvimos a casa.", "Nuestros vecinos cantan en el coro todos los jueves."],
    "pt": ["A minha avó cria três galinhas atrás do velho celeiro.", "Choveu a noite inteira e o rio tinha subido de manhã.", "Ela vendeu a bicicleta porque ninguém consertava os travões.", "Quase não havia pão quando chegámos a casa.", "Os nossos vizinhos cantam no coro todas as quintas-feiras."],
    "ru": ["Моя бабушка держит трёх кур за старым сараем.", "Всю ночь шёл дождь, и к утру река поднялась.", "Она продала велосипед, потому что никто не чинил тормоза.", "Когда мы вернулись домой, хлеба почти не осталось.", "Наши соседи поют в хоре каждый четверг."],
    "zh": ["我的祖母在旧谷仓后面养了三只母鸡。", "下了一整夜的雨，早上河水涨了起来。", "她把自行车卖掉了，因为没有人修刹车。", "我们回到家的时候，面包几乎没有了。", "我们的邻居每个星期四都去合唱团唱歌。"],
    "ja": ["祖母は古い納屋の裏で三羽の鶏を飼っています。", "一晩中雨が降ったので、朝には川の水が増えていました。", "誰もブレーキを直さないので、彼女は自転車を売りました。", "家に帰ったとき、パンはほとんど残っていませんでした。", "近所の人たちは毎週木曜日に合唱団で歌います。"],
}


def test_prose_of_other_subjects(spark, sf):
    """Models trained on the tables, tried on texts that no generator of theirs wrote: single languages, and two in one."""
    model = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    singles = [(10_000 + i, " ".join(s), None) for i, s in enumerate(PROSE.values())]
    pairs = [(a, b) for a in PROSE for b in PROSE if a < b]
    doubles = [(20_000 + i, " ".join(PROSE[a]) + "\n\n" + " ".join(PROSE[b]), None) for i, (a, b) in enumerate(pairs)]
    got: dict[int, set[str]] = {}
    for r in L.cases(L.identify(model.unionByName(spark.createDataFrame(singles + doubles, "doc_id bigint, text string, lang string")))).where("doc_id >= 10000").collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert sum(got.get(10_000 + i) == {k} for i, k in enumerate(PROSE)) == len(PROSE)
    assert sum(got.get(20_000 + i) == {a, b} for i, (a, b) in enumerate(pairs)) >= 0.9 * len(pairs)
