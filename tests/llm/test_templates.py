import pytest

from spanlake.llm.templates import Detector, fold, judge, residue, tokens
from tests.conftest import rows

CONTENT = [
    None, "", "  \n ", "The clerk searched the register but the\npage was not found, and the entry was declared\nlost.", "Of the 404 bales sent to Grinwick, none\nwas found wanting.", "He wrote his sum as { 2, 4,\n8 } and asked for the next.",
    "The figure {see plate} was engraved.", "<< See last column >>", "*** The editor is not bound\nto return copy ***", "[From our own correspondent]", "[Advt.]", "[To be continued in our next]", "!!!???;;;---===", "<|endoftext|>", "Prices fell 5% and then 10%; the shares stood at $4 and\n$7",
    "The magistrate said that access was denied to no honest man.", "The word servants is forbidden on the notice, said the\ninspector, who filled in", "The gateway was blocked for some time and carts", "The printer set dummy copies of the ballot, which were burned.",
    "Owing to an error in the service of the ferry, the boat was unavailable for 503 passengers.", "Subscribers @ 6d. the quarter, # 14 Mill Lane.", "The prompter held that a new script is required before the play", "La page du registre était\nintrouvable.", "Die Seite des Buches wurde nicht gefunden, und der Fehler blieb.", "Al(lerman pri(e Publi( &c. 25% off",
    "The connection failed at noon and the train was late.", "The council went wrong while dealing with the drains.", "The request for this was refused by the mayor.", "An invalid response was given in your browser settings column.",
]
SLOTS = [
    "{{headline}}", "a {town} b", "{{{price}}}", "[[page_no]]", "x ${author} y", "$ISSUE_NO$", "%dateline%", "%%byline%%", "<%= edition %>", "<?= $town ?>", "@@section@@", "__caption__", "[%price%]", "{% town %}", "{!issue.number!}", "[{caption}]", "<<byline>>", "&issue_date;", "#{subhead}", "%(author)s",
    "[INSERT HEADLINE HERE]", "{advert text missing – fill\nin}", "<YOUR TOWN>", "(((TITEL EINFÜGEN)))", "*** Bildtext folgt ***", "[ insérer le titre ]", "{name of corresponclent}", "[PHOTO CAP-\nTION TO COME]", "{ {caption} }", "sold %s of %s so", "{0} and {1}", "%1$s", "[object Object]", "#REF!", "NULL NULL", "NaN d.", "Apply to undefined,\nundefined now",
]
MESSAGES = [
    "Error 404: página no encontrada.", "ALDFORD MERCURY\nFehler 400: Die Seite wurde\nnicht gefunden.", "Please enable Javascript to view this page.", "Veuillez activer scripting pour consulter cette page.", "noſcript: Javascript disabled", "Bitte aktivieren Sie\nscripts, um die Seite anzuzeigen.",
    "The reader could not be\nloaded.", "Item ab12 is not responding.", "Not Found", "502 Bad Gateway", "Gone\nThe server could not complete your request for this scan.", "The facsirnile cannot be displayed.", "El serviclor no pudo completar la solicitud.", "Tlie arcliive was not found on tbis scrvcr.", "This issue is tempo-\nrarily unavailable.",
]
FILLERS = ["Lorem ipsum dolor sit amet", "a b\nvelit 0rna felis magna\nc", "bla bla blah etc. bla", "xxxx xx xxxxx. xxx", "Copy TK. Copy TK. Copy TK.", "test asdf jkl qwer", "Some thing here. Some thing here. Some thing here.", "Filler filler filler filler."]


@pytest.fixture(scope="module")
def detector():
    return Detector()


@pytest.mark.parametrize(("texts", "kinds"), [(CONTENT, {None}), (SLOTS, {"slot"}), (MESSAGES, {"message"}), (FILLERS, {"filler", "message"})])
def test_kinds(detector, texts, kinds):
    wrong = [(t, k) for t in texts if (k := detector.kind(t)) not in kinds]
    assert not wrong
    before, after = "The old harbour of Kelford was opened on Monday last.\n", "\nGreat was the surprise when the\nmill was sold."
    wrong = [t for t in texts if t and detector.kind(before + t + after) not in kinds]
    assert not wrong


def test_folding():
    assert fold("THE reader") == fold("tbe rcader") and fold("modern") == fold("modem") and fold("page 12") == fold("page 7,5")
    assert tokens(fold("Item 59 a1"))[1] == "<n>"


def test_frame(spark):
    df = spark.createDataFrame([(1, "{{x_y}}"), (1, "{{x_y}}"), (None, "bla bla bla bla"), (2, None), (3, "plain " * 200_000)], "doc_id bigint, text string").selectExpr("*", "1 AS kind")
    assert rows(residue(df)) == [(None, "filler"), (1, "slot"), (1, "slot")]
    assert rows(judge(df.limit(0))) == []


FOREIGN = "\nDie Gesellschaft und die öffentliche Verwaltung von Aldwick haben\nWie man aus Lundmoor meldet, hat Mrs. M. die Sitzung besucht\nLysken continued the work at the mill   and the narrow library was opened\n"
LONG_SLOTS = [
    f"[ INSÉRER{FOREIGN}LE TITRE ]", f"(((PHOTO CAPTION TO{FOREIGN}that not fewer than 76 persons pur-\nCOME)))", f"{{in-{FOREIGN}sert caption}}", f"<PLACE SHIPPING LIST{FOREIGN}HERE>", f"***{FOREIGN}ADD PRICE ***", f"[name{FOREIGN}of correspondent]",
    f"a [ stray mark and [INSERT{FOREIGN}HEADLINE]", f"[INSERT [Advt.]{FOREIGN}HEADLINE]",
]
LONG_CONTENT = [f"{{ 2, 4,{FOREIGN}add your name here\n8 }}", f"[From our{FOREIGN}own correspondent here]", f"*** The editor is not bound to{FOREIGN}return your copy ***", f"[{FOREIGN}]"]


def test_fields_of_any_length(detector):
    assert [t for t in LONG_SLOTS if detector.kind(t) != "slot"] == []
    assert [t for t in LONG_CONTENT if detector.kind(t) is not None] == []


FAR = "\n" + "".join(f"The worthy farmer of Yarlmere repaired\nthe tariff on Saturday, and {i} persons\nwere hurt beside the quar-\n" for i in range(30))
CUT_MESSAGES = [
    f"The reader{FAR}could not be loaded.", f"This{FAR}issue cannot{FAR}be displayed", f"Item 95867 has been removed   of the committee{FAR}or renamed.", f"Diese Anwendung benötigt{FAR}aktiviertes Javascr", f"The requested page could not be loa-{FAR}ded.",
    f"Database connection{FAR}failed: too many", f"404{FAR}Forbidden", f"Fehler{FAR}503: Die Seite", f"The page you{FAR}requested does{FAR}not exist", f"The page   clerk was{FAR}is not   the farmer{FAR}responding", f"This{FAR}archive is{FAR}temporarily{FAR}unavailable",
]
CUT_CONTENT = [
    f"93{FAR}Not{FAR}found supported beside the warehous-", f"2{FAR}forbidden on the notice,", f"410{FAR}gone to the fair", f"The reader{FAR}said it could not be loaded", f"said the reader{FAR}could not be loaded", f"The page was{FAR}not found, and the entry was declared",
    f"This issue and{FAR}is not responding",
]


def test_messages_cut_anywhere(detector):
    assert [t for t in CUT_MESSAGES if detector.kind(t) != "message"] == []
    assert [t for t in CUT_CONTENT if detector.kind(t) is not None] == []
