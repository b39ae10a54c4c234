import pytest
from pyspark.sql import functions as F

from quillgrid.llm import pairs
from quillgrid.llm.language import Profile, fit, fit_languages
from quillgrid.llm.pairs import defective_pairs, lcs
from quillgrid.llm.refusals import is_refusal

#: Everyday sentences that share nothing with the tables; each language as often as a profile needs.
SENTENCES = {
    "en": "We walked along the river until the rain began to fall. The children have been asking for their books since this morning. She told me that the train was late because of the snow. Which of the two houses would you like to see first? There is no reason to believe that they will come back. How many people were at the market with you? It was the best soup that he had ever eaten in his life.",
    "de": "Wir gingen am Fluss entlang, bis der Regen zu fallen begann. Die Kinder haben seit heute Morgen nach ihren Büchern gefragt. Sie sagte mir, dass der Zug wegen des Schnees zu spät war. Welches von den beiden Häusern möchtest du zuerst sehen? Es gibt keinen Grund zu glauben, dass sie nicht zurückkommen. Wie viele Leute waren mit dir auf dem Markt? Das war die beste Suppe, die er in seinem Leben gegessen hatte.",
    "fr": "Nous avons marché le long de la rivière jusqu'à ce que la pluie commence. Les enfants demandent leurs livres depuis ce matin avec leur mère. Elle m'a dit que le train était en retard à cause de la neige. Laquelle des deux maisons veux-tu voir en premier? Il n'y a aucune raison de croire qu'ils ne reviendront pas. Combien de gens étaient au marché avec vous? C'était la meilleure soupe qu'il avait mangée dans sa vie.",
    "es": "Caminamos por la orilla del río hasta que empezó a llover. Los niños han pedido sus libros desde esta mañana con su madre. Ella me dijo que el tren llegaba tarde por la nieve. ¿Cuál de las dos casas quieres ver primero? No hay ninguna razón para creer que no volverán. ¿Cuántas personas estaban en el mercado contigo? Era la mejor sopa que había comido en su vida.",
}
LABELLED = [(lang.upper() if k % 5 == 0 else lang, text) for lang, text in SENTENCES.items() for k in range(16)]
PROFILE = fit(LABELLED)


def defect(q, a, marked=True):
    return pairs.defect(q, a, PROFILE, marked)


Q = "Which row holds the highest dense density, Velgreven or Delbesenene?"
A = "The total for Tholous is 80 kPa, of which 3 belongs to harnite."

CASES = [
    (Q, A, None), (Q, None, "empty"), (Q, " \t\n", "empty"), (Q, "—", "empty"), (Q, "{}", "empty"), (Q, "```\n```", "empty"), (Q, "<table><tr><td></td></tr></table>", "empty"), (Q, "N/A", "empty"), (Q, "(empty)", "empty"),
    (Q, "0", None), (Q, "-7", None), (Q, "%", None), (Q, "No", None), (Q, "None of them.", None), (Q, "Velgreven", None), (Q, "95 mg/L", None), (Q, "June 2011", None), (Q, "Mirrand Ltd.", None),
    (Q, "Sorry, I can't assist with reading this picture.", "refusal"), (Q, "Leider muss ich das ablehnen und bitte um Verständnis.", "refusal"), (Q, "很抱歉，我无法回答这个请求，感谢您的理解。", "refusal"),
    (Q, "This cannot be answered from the table, which lists Velgreven only.", None), (Q, "I am unable to confirm the mark, yet the ratio of Velgreven is printed as 9 EUR.", None), (Q, "Sorry for the odd unit: the length of Velgreven is 9 Hz.", None),
    (Q, Q, "copy"), (Q, Q.upper(), "copy"), (Q, f"“{Q}”", "copy"), (Q, f"You asked: {Q}", "copy"), (Q, f"{Q}\n{Q}", "copy"), (Q, Q.replace("highest", "highst"), "copy"), ("<image>" + Q, Q, "copy"),
    (Q, f"You ask: “{Q}” {A} And the last of them closes the table with all of its cells.", None),
    (Q, A[:40], "truncated"), (Q, '{"a": "1", "b', "truncated"), (Q, '{"a": "1"}', None), (Q, "<fcel>a<fcel>b<nl>\n<fcel>c", "truncated"), (Q, "<fcel>a<nl>\n", None), (Q, "<table><tr><td>a</td></tr>", "truncated"), (Q, "The rows are:\n- A: 3 kg;\n-", "truncated"),
    (Q, "Selon la note 15, Velleke a été mesuré avec une sonde. Le rapport entre eux vaut 2.", "language"), ("Translate into French: the row is long.", "La ligne est longue, avec une colonne dont le rapport vaut 2.", None),
    ("Quelle valeur le tableau donne-t-il pour Thonaous sous capacité ?", A, "language"), (None, A, None), ("", A, None), (None, "Selon la note, le rapport est de 2.", None),
]


@pytest.mark.parametrize("q,a,want", CASES)
def test_defects(q, a, want):
    assert defect(q, a) == want


def test_lcs():
    assert lcs("abcde", "ace") == 3 and lcs("", "x") == 0 and lcs("aab", "baa") == 2


def test_frame(spark):
    rows = [(k, q, a) for k, (q, a, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:3], "row_id bigint, q string, a string").withColumn("defect", F.lit("clash"))
    got = {r["id"]: r["defect"] for r in defective_pairs(df, "row_id", "q", "a", PROFILE).collect()}
    assert got == {k: w for k, (_, _, w) in enumerate(CASES) if w}
    assert defective_pairs(df.limit(0), "row_id", "q", "a", PROFILE).count() == 0


def test_long_texts():
    assert defect(Q, A * 20_000) is None
    assert defect(Q, (A + " ") * 5_000 + "And then") == "truncated"


def test_long_copies_and_refusals():
    q = "Which row of the table holds the largest?"
    assert [defect(q, " ".join([q] * k) + ".") for k in (2, 12, 3000)] == ["copy"] * 3
    assert defect(q, " ".join([q.replace("largest", "lagest")] * 12)) == "copy"
    assert defect(q, " ".join(["Sorry, I can't assist with reading this picture."] * 20)) == "refusal"
    assert defect(q, "Sorry, I can't assist with reading this picture. " + "The third row holds 12 tonnes of ore. " * 20) is None
    assert defect(q, " ".join([q] * 3) + " The third row holds the most, 1998 tonnes of iron ore from the northern works, as its last cell states in full.") != "copy"


#: Wordings that occur in no table.
DECLINED = [
    "I'm afraid I can't do that.", "I'm sorry, but I can't provide that information.", "As an AI, I am unable to comply with this request.", "I cannot fulfill this request.", "I'd rather not answer that question.",
    "Unfortunately we are not permitted to share that. Please try something else.", "Sorry. I won't continue with this task.", "Das kann ich leider nicht beantworten.", "Ich darf Ihnen dabei nicht weiterhelfen. Danke für Ihr Verständnis.",
    "Ich lehne diese Aufgabe ab.", "Je ne peux pas donner suite à cette question.", "Nous refusons de traiter cette image.", "Lo lamento, no puedo atender su consulta.", "Prefiero no contestar.", "抱歉，我不能协助处理这张图片。", "这个问题我无法回应，请谅解。",
]
ANSWERED = [
    "I could not find a value for June.", "The column does not say.", "I cannot answer the first part, but the second is higher in Lyon.", "Sorry for the wait. The total is 45.", "We cannot rule out a typing error.", "Not stated.", "Der Wert fehlt in der Tabelle.",
    "Ich kann den Wert nicht finden.", "Le tableau ne donne pas ce chiffre.", "La tabla no indica ese dato.", "表中没有给出该数值。", "I can help: the largest is Oslo.", "They declined by a third in spring.", "I am not able to say, since the table lists no dates.", "Please see the second row.",
]


def test_held_out_refusals():
    found = [is_refusal(x) for x in DECLINED]
    wrong = [x for x in ANSWERED if is_refusal(x)]
    assert sum(found) / len(found) >= 0.9 and not wrong


FOREIGN = [
    "La stazione si trova vicino al fiume e alla piazza grande.", "Os preços subiram muito durante o último verão.", "Доход вырос за последние годы почти вдвое.", "收入在去年明显增加了。", "Der Umsatz ist in den letzten Jahren stark gestiegen.",
    "Les ventes ont beaucoup augmenté pendant les dernières années.", "Las ventas han subido mucho durante los últimos años.",
]
ENGLISH = ["Sales went up a lot during the last few years.", "None of them was open that day.", "Oslo, Bergen and Tromsø are the largest of them.", "Mainly because the port of Hamburg was closed in May.", "There are 12 of them."]


def test_held_out_languages():
    q = "What happened to the sales in the last few years?"
    assert sum(defect(q, a) == "language" for a in FOREIGN) >= 6
    assert all(defect(q, a) is None for a in ENGLISH)
    assert defect("Wie hat sich der Umsatz in den letzten Jahren verändert?", ENGLISH[0]) == "language"


def test_whole_values_and_unmarked_columns():
    for a in ("45 million euros in total", "Berlin, Hamburg and Munich", "Lake Constance", "12 percent", "3.5 t/ha", "Q3 2019"):
        assert defect("Which is it?", a) is None
    for a in ("Revenue grew in the north because of the", "The three largest cities are Berlin, Hamb", "It was sold by"):
        assert defect("Which is it?", a) == "truncated" and defect("Which is it?", a, marked=False) is None
    assert defect("Which is it?", "<table><tr><td>a", marked=False) == "truncated"


def test_columns_without_marks(spark):
    rows = [(k, "Which row is the longest?", f"the longest row by far is number {k} of the second table") for k in range(20)]
    df = spark.createDataFrame(rows, "row_id bigint, q string, a string")
    assert not pairs.marked_column(df, "a") and defective_pairs(df, "row_id", "q", "a", PROFILE).count() == 0


def test_profiles(spark):
    assert PROFILE.names == ["de", "en", "es", "fr"] and "the" in PROFILE.frequent["en"]
    df = spark.createDataFrame([(k, t, f" {l} ") for k, (l, t) in enumerate(LABELLED)] + [(99, None, "en"), (100, "x", None), (101, "Solo.", "it")], "doc_id bigint, text string, lang string").withColumn("h", F.lit("clash"))
    got = fit_languages(df, "doc_id", "text", "lang")
    assert got.names == PROFILE.names and (got.weights == PROFILE.weights).all() and got.frequent == PROFILE.frequent and got.common == PROFILE.common
    none = fit_languages(df.limit(0), "doc_id", "text", "lang")
    assert none.names == [] and none.of("Sales went up a lot") is None and none.of("Доход вырос за последние годы") == "CYRILLIC"
    assert Profile([], none.weights, {}).of("") is None
