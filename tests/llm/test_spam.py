import random

from ledgerlake.llm.spam import blocks, is_loose, pieces, shape_of, spam_documents, spam_share

SCHEMA = "doc_id long, text string, lang string, size int, raw double"
WORDS = "rental copper fleet harvest timber payments orchard staffing reagent polymer".split()


def prose(rnd, n):
    out = []
    for _ in range(n):
        a, b, c = rnd.sample(WORDS, 3)
        out.append(rnd.choice([
            f"The board believes that the {a} reserves shown in the {b} note are sufficient for {rnd.randrange(2000, 2025)}.",
            f"Of the total, {rnd.randrange(90)} percent came from {a} and the rest from {b} and {c} in the second half.",
            f"We lease {rnd.randrange(400)} {a} locations, most of them in the {b} region near the coast.",
            f"Interest on the {a} facility is payable at {rnd.randrange(9)}.{rnd.randrange(9)} percent after the {c} year.",
        ]))
    return " ".join(out)


def keywords(rnd):
    k = [f"{rnd.choice(WORDS)} {rnd.choice(['score', 'loan', 'price'])}" for _ in range(3)]
    return ", ".join(rnd.choice(k) for _ in range(80))


def links(rnd):
    return "\n".join(f"https://www.{rnd.choice(WORDS)}{rnd.randrange(999)}.example/{rnd.choice(WORDS)}" for _ in range(25))


def tags(rnd):
    return " ".join(f"#{rnd.choice(WORDS)}{rnd.choice(['', '7'])}" for _ in range(90))


def products(rnd):
    return "\n".join(f"{rnd.choice(WORDS).title()} {rnd.choice(WORDS).title()} SKU-{rnd.randrange(9999)} {rnd.choice(['new', 'sale', ''])}" for _ in range(50))


def empty_sentences(rnd):
    k = [f"{a} loan" for a in rnd.sample(WORDS, 3)]
    return " ".join(rnd.choice(["Looking for {0}? Our {0} is the {0} you want.", "Get {0}, compare {0}, order {0} now."]).format(rnd.choice(k)) for _ in range(25))


SPAM = [keywords, links, tags, products, empty_sentences]


def exhibits(rnd):
    return "\n".join(f"{i}.{rnd.randrange(9)}  {rnd.choice(WORDS).title()} {rnd.choice(WORDS)} agreement dated 20{rnd.randrange(10, 25)}, filed herewith" for i in range(1, 25))


def figures(rnd):
    return "\n".join(f"{rnd.choice(WORDS).title()} {rnd.randrange(9999):,} {rnd.randrange(9999):,} ({rnd.randrange(99)}) {rnd.randrange(99)}%" for _ in range(30))


def test_kinds_of_pages(spark):
    rnd = random.Random(9)
    rows, want = [], set()
    for i in range(300):
        rows.append((i, prose(rnd, rnd.randrange(4, 16)), "en", 1, 0.0))
    for i in range(300, 350):
        make = SPAM[i % 5]
        rows.append((i, make(rnd), "EN", 1, 0.0))
        want.add(i)
    for i in range(350, 400):  # prose with a short tail, lists of exhibits, rows of figures
        tail = rnd.choice([links, tags])(rnd).split()[:3]
        rows.append((i, rnd.choice([prose(rnd, 9) + "\n\nSee also:\n" + "\n".join(tail), prose(rnd, 4) + "\n" + exhibits(rnd), prose(rnd, 4) + "\n" + figures(rnd)]), "en-US", 1, 0.0))
    for i in range(400, 420):  # spam with some sentences set into it
        parts = SPAM[i % 5](rnd).split("\n" if i % 5 in (1, 3) else " ")
        parts.insert(len(parts) // 2, prose(rnd, 1))
        rows.append((i, ("\n" if i % 5 in (1, 3) else " ").join(parts), None, 1, 0.0))
        want.add(i)
    rows += [(900, None, "en", 1, 0.0), (901, "", "en", 1, 0.0), (902, "  \n ", None, 1, 0.0), (903, "Hello.", "en", 1, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id for r in spam_documents(df).collect()}
    assert got == want


def test_measures():
    assert pieces("") == [] and blocks("") == []
    assert is_loose("payday loan; gold price; payday loan; gold price") and not is_loose("The board of the company is in the region.")
    assert not is_loose("3.1  Broader payments agreement dated 2018, filed herewith") and is_loose("https://www.a.example/b")
    assert shape_of("See #tag and https://a.example/x for 3 cats") == "X H and L for 9 cats"
    long = "word " * 100_000
    assert sum(b[0] for b in blocks(long)) > 400_000


def test_empty_table(spark):
    assert spam_share(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_text_takes_quadratic_time():
    import time

    n = 200_000
    began = time.process_time()
    for unit in ("a", "a-", "a.", "<a>", "[", "#a ", "$A", "http://", "www.", "\n", " ", ". ", "x/ ", "é"):
        blocks(unit * (n // len(unit)))
    assert time.process_time() - began < 20


def test_spam_majority_of_a_language(spark):
    for n in (99, 100, 400):  # whatever the number of its blocks
        rnd = random.Random(n)
        rows = [(i, prose(rnd, rnd.randrange(4, 16)), "en", 1, 0.0) for i in range(200)]
        page = tags(random.Random(1))
        k = len(blocks(page))
        want = set(range(1000, 1000 + -(-n // k)))
        rows += [(i, page, "de", 1, 0.0) for i in want]  # copies of one page
        more = set(range(5000, 5030))
        rows += [(i, links(rnd), "fr", 1, 0.0) for i in more] + [(6000 + i, prose(rnd, 9), "fr", 1, 0.0) for i in range(5)]
        got = {r.doc_id for r in spam_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == want | more, n


def test_block_count_of_a_language_is_no_switch(spark):
    rnd = random.Random(4)
    page = keywords(rnd)
    k = len(blocks(page))
    for n in (99 // k, -(-100 // k)):  # nothing but spam, on both sides of 100 blocks
        got = spam_documents(spark.createDataFrame([(i, page, "es", 1, 0.0) for i in range(n)], SCHEMA)).count()
        assert got == n


def test_prose_of_other_languages_is_kept(spark):
    rnd = random.Random(5)
    words = "azienda ricavi debito mercato vendite costi utile banca tasso anno".split()
    italian = [" ".join(f"Gli {rnd.choice(words)} della {rnd.choice(words)} sono cresciuti nel {rnd.choice(words)} dopo {rnd.randrange(99)} {rnd.choice(words)}." for _ in range(12)) for _ in range(200)]
    rows = [(i, t, "it", 1, 0.0) for i, t in enumerate(italian)] + [(1000 + i, prose(rnd, 9), "en", 1, 0.0) for i in range(300)]
    assert spam_documents(spark.createDataFrame(rows, SCHEMA)).count() == 0


OTHER_PROSE = {
    "it": "La società ha chiuso l'esercizio con ricavi in lieve crescita, nonostante il rallentamento della domanda nel secondo semestre. Il consiglio di amministrazione propone agli azionisti un dividendo inferiore a quello dell'anno scorso. I costi dell'energia restano elevati e pesano soprattutto sugli stabilimenti del nord. Nei prossimi mesi la direzione intende ridurre il debito e vendere due immobili non più utilizzati. I revisori non hanno espresso rilievi sul bilancio.",
    "pl": "Spółka zakończyła rok obrotowy z niewielkim wzrostem przychodów, mimo słabszego popytu w drugiej połowie roku. Zarząd proponuje wypłatę niższej dywidendy niż przed rokiem. Koszty energii pozostają wysokie i obciążają głównie zakłady na północy kraju. W najbliższych miesiącach kierownictwo chce zmniejszyć zadłużenie oraz sprzedać dwie nieużywane nieruchomości. Biegły rewident nie zgłosił zastrzeżeń do sprawozdania.",
    "ru": "Компания завершила год с небольшим ростом выручки, несмотря на слабый спрос во втором полугодии. Совет директоров предлагает выплатить дивиденды ниже прошлогодних. Расходы на энергию остаются высокими и давят прежде всего на северные заводы. В ближайшие месяцы руководство намерено сократить долг и продать два неиспользуемых здания. Аудиторы не высказали замечаний к отчётности.",
    "zh": "公司本年度收入略有增长，尽管下半年需求放缓。董事会建议派发低于去年的股息。能源成本仍然很高，主要影响北方的工厂。未来几个月，管理层打算减少债务，并出售两处闲置的房产。审计师对财务报表没有提出保留意见。",
}


def test_prose_of_any_language_alone_is_kept(spark):
    rows = [(i, t, lang, 1, 0.0) for i, (lang, t) in enumerate(OTHER_PROSE.items())]
    bare = OTHER_PROSE["it"].replace(".", "").replace(",", "")
    rows.append((10, bare, "it", 1, 0.0))  # loose without any mark, but not redundant enough
    got = {r.doc_id: r.spam_share for r in spam_share(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 5 and got.pop(10) < 0.5 and max(got.values()) < 0.1, got


def test_spam_of_other_languages_is_found(spark):
    k = ["tanie pożyczki online", "kredyt bez bik", "chwilówki przez internet"]
    rnd = random.Random(3)
    polish = ", ".join(rnd.choice(k) for _ in range(60))
    russian = "\n".join(f"Купить {rnd.choice(['акции', 'золото', 'кредит'])} дёшево {rnd.randrange(9999)}" for _ in range(40))
    rows = [(1, polish, "pl", 1, 0.0), (2, russian, "ru", 1, 0.0), (3, OTHER_PROSE["pl"], "pl", 1, 0.0)]
    assert {r.doc_id for r in spam_documents(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 2}


def test_long_anchors_are_links():
    page = "\n".join(f'<a href="https://a.example/{"p/" * 400}{i}">{"gold price " * 40}{i}</a>' for i in range(20))
    assert all(is_loose(p, v) for p, v in pieces(page))
