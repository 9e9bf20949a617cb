"""The small labelled table from which the field on personal information is trained.

Everything here is written from public formats and general language: numbering plans of several countries, forms of identity
numbers, common given and family names, made-up names by syllables, host names under public endings. ``OPENINGS`` and ``ENDINGS``
surround a place of a kind; ``PLAIN`` and ``codes`` give sentences without personal information, many of them close to it.
``examples`` joins them by rule; ``part`` keeps a share of the frames and names apart, for measuring.
"""

from __future__ import annotations

import random

KINDS = ("email", "phone", "id_number", "address", "name")

#: Common given names.
GIVEN = """James Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Steven Paul Andrew Kenneth Emma Jessica Sarah Karen Nancy Laura Susan Rebecca
Amanda Stephanie Olivia Sophie Chloe Ethan Liam Noah Mason Hannah Zoe Hans Klaus Jürgen Wolfgang Stefan Markus Sabine Ursula Heike Monika Katrin Anke Jean Philippe Nicolas
Antoine Guillaume Camille Sylvie Chantal Élodie Margaux Javier Alejandro Miguel Pablo Sergio Isabel Pilar Mercedes Rocío Giovanni Alessandro Lorenzo Stefano Francesca Chiara
Elena Federica João Gonçalo Catarina Mafalda Joost Willem Maarten Femke Lotte Anouk Mohammed Yusuf Fatima Aisha Omar Leila Wei Jing Hiroshi Yuki Arjun Deepa Rahul
Sunita Olga Dmitri Svetlana Milan Katarzyna Piotr Agnieszka Björn Ingrid Lars Astrid Kwame Chidi Amina Tariq Zeynep Mehmet Nikos Sofia Andrei Ioana Jack Harry Lucy Ella""".split()
#: Common family names.
FAMILY = """Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green
Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart Morris Rogers Reed Cook Morgan Bell Murphy Bailey O'Connor McDonald
Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Schröder Neumann Krüger Hartmann Martin Bernard Dubois Laurent Lefebvre Michel Girard
Bonnet Mercier Blanc Guérin Fernández González López Martínez Sánchez Pérez Gómez Ruiz Díaz Álvarez Romero Navarro Torres Bianchi Romano Colombo Ricci Marino Greco Conti Costa
Santos Oliveira Pereira Carvalho Almeida Ribeiro Lopes Sousa de~Jong van~Dijk Bakker Visser Smit Meijer de~Boer Mulder Bos Kowalski Nowak Ivanov Popescu Horvat Andersen Hansen
Nilsson Larsson Virtanen Yılmaz Kaya Demir Ali Hussein Rahman Patel Sharma Singh Gupta Wang Zhang Nguyen Kim Park Tanaka Suzuki Mensah Adeyemi Diallo Traoré""".replace("\n", " ").split()
#: Towns.
PLACES = "London Manchester Bristol Boston Chicago Denver Berlin Hamburg Köln Stuttgart Leipzig Paris Marseille Nantes Lille Madrid Sevilla Bilbao Milano Torino Bologna Porto Braga Coimbra Utrecht Rotterdam Eindhoven Antwerp Zürich Graz".split()
#: Kinds of streets.
ROADS = "Street St St. Road Rd Rd. Lane Ln Avenue Ave Ave. Drive Dr Close Court Ct Terrace Way Square Boulevard Blvd Crescent Place Park Hill Grove Gardens Row".split()
WAYS = ["straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ring", "damm", "ufer", "straat", "laan", "gracht", "plein"]
STREETS = ["rue", "rue", "rue", "avenue", "boulevard", "place", "chemin", "impasse", "allée"]
CALLES = ["Calle", "Calle", "C/", "Avenida", "Plaza", "Paseo", "Via", "Via", "Viale", "Piazza", "Corso", "Rua", "Rua", "Travessa", "Largo"]
OF = ["du", "de la", "des", "de l'", "de", "del", "della", "dos", "da", ""]
#: Little words of several languages.
LITTLE = """the a and but so of in on at with for it is was very not we they my our der die das und aber mit für auf im nicht sehr ist war wir le la les et mais avec pour sur dans est nous notre el los y pero con para sobre en es muy il lo gli e ma per su nel è
molto o os mas com para sobre no é muito nossa het een en maar met voor op van zijn wij heel once after before since until about when because although trotz nach seit bis weil als après depuis jusqu quand parce tras desde hasta cuando porque dopo da fino quando perché depois desde até quando porque na sinds tot toen omdat""".split()
#: Endings of host names.
TLDS = "com com com com net org io de fr es it pt nl co.uk eu info biz me us ch at be dev app shop online test example invalid".split()
#: Nouns for things, streets and brands.
NOUNS = """kettle toaster blender pillow blanket lamp backpack tent stroller helmet keyboard printer fridge oven pan knife spoon mug bottle jug basket bucket ladder drill hammer saw scooter
bench chair table desk shelf drawer carpet curtain mirror clock radio speaker headset tablet phone case charger plug socket fuse pump hose valve filter cover belt wheel tyre pedal brake
garden river forest meadow orchard castle bridge church station market harbour mill tower lake valley""".split()
ADJECTIVES = "golden silver quiet rapid bright royal northern wild happy solid polar amber crimson noble little great blue green iron lucky smooth fresh sunny alpine urban".split()

#: What may stand before a place of each kind.
OPENINGS = {
    "email": """write to|mail|e-mail me at|email:|e-mail|my e-mail address:|reply to|contact|contact me under|send it over to|cc|inbox|answer goes to|I use|they have my address|forwarded to|(|<|mailto:|
kontakt:|meine Mailadresse lautet|schreiben Sie an|Antwort an|E-Mail an|écrivez à|mon courriel :|adresse mail|répondre à|escríbeme a|mi correo electrónico:|correo|responder a|scrivete a|la mia mail:|contattatemi a|posta:|escrevam para|
o meu e-mail:|correio|mail naar|mijn e-mailadres:|stuur het naar|registered under|the account belongs to|invoice sent to|got an answer from""",
    "phone": """call|call me at|ring|phone|phone:|tel|tel.:|Tel|telephone number|mobile|mobile:|cell|cell:|cell/|my number:|text me on|text|SMS to|WhatsApp|whatsapp:|reach me at|composez le|téléphonez au|faites le|wählen Sie|available under|dial|hotline|fax|or by phone|number=|
ring back on|rufen Sie an:|Telefon|Handy|Handynummer|unter der Nummer|erreichbar unter|melden Sie sich unter|téléphone|portable :|appelez-moi au|joignable au|mon numéro :|tél.|llamar al|móvil|teléfono|mi número:|llámenme al|
chiamare il|cellulare|telefono|numero:|ligue para|telemóvel|telefone|contacto|bel naar|telefoon|mobiel|mijn nummer:|te bereiken op""",
    "ssn": "SSN|my SSN is|ssn:|social security number|social security no.|Social Security|soc. sec. no.|the social security number|social security card|last payslip with social security number|social sec",
    "nino": "national insurance number|national insurance no.|NI number|NI no.|NINO|nino:|my NI|insurance number (NI)|National Insurance|NINO is",
    "tax": """tax number|tax id|tax ID:|tax identification|tax file number|TIN|my tax number is|taxpayer number|Steuernummer|Steuer-ID|steuerliche Identifikationsnummer|Steueridentifikationsnummer|numéro fiscal|numéro d'impôt|
número fiscal|NIF|NIE|codice fiscale|contribuinte|BSN|burgerservicenummer|fiscaal nummer""",
    "pass": "passport|passport number|passport no.|passport no|passport:|my passport is|copied my passport|Reisepass|Reisepass Nr.|Passnummer|numéro de passeport|passeport|passeport n°|pasaporte|número de pasaporte|passaporto|passaporte|número do passaporte|paspoort|paspoortnummer",
    "address": """deliver to|send to|ship it to|shipping address|address:|my address is|our home is|I live at|the parcel went to|they left it at|dropped off at|collect it at|the shop on|return to|go to|from|near|invoice address|
Lieferadresse|wohnhaft|geliefert an|bitte an die|Anschrift|Adresse :|livraison au|j'habite|nous habitons au|expédier au|adresse|vivo en|la dirección es|entregar en|enviar a|abito in|l'indirizzo è|consegnare in|spedire a|
moro na|morada|entregar na|enviar para|bezorgen op|ik woon op|adres|afgeleverd bij|(|we moved away from|the old flat,""",
    "name": """I am|I'm|the name is|name:|Name|full name:|called|named|Mr|Mr.|Mrs|Mrs.|Ms|Miss|Dr|Dr.|Sir|Madam|yours,|Best,|Cheers,|Kind regards,|Sincerely,|signed|signed by|written by|posted by|thank you|many thanks to|kudos to|
spoke with|talked to|a certain|the clerk|the driver,|the courier|the postman|our plumber|my colleague|my friend|my husband|my wife|my boss|our landlord|the manager,|agent|the engineer|customer|ask|ask to see|give it to|left with|handed over to|collected by|
picked up by|delivered to|it was|from|by|for|on behalf of|attention:|c/o|--|~|Herr|Frau|Herrn|ich bin|mein Name:|Gruß,|Mit freundlichen Grüßen|Monsieur|Madame|M.|Mme|je suis|mon nom :|cordialement,|Señor|Señora|Sr.|Sra.|soy|
mi nombre:|atentamente,|un saludo,|Signor|Signora|sono|il mio nome:|cordiali saluti,|Senhor|Senhora|sou|o meu nome:|cumprimentos,|meneer|mevrouw|dhr.|mijn naam:|groeten,|namens|with|says|and|this was|again|hello|dear|hi|technical help:|
der Techniker|die Verkäuferin|le technicien|la vendeuse|el técnico|la vendedora|il tecnico|o técnico|de monteur|neighbour|our neighbour|my neighbor,|wie heißt|man nennt mich|on m'appelle|se llama|mi chiamano|chamam-me|men noemt mij|heiße|appelle|llamo|chiamo|chamo|heet""",
}
#: What may stand behind any place.
ENDINGS = """|.|!|, please|please|, thank you|any time|before noon|in the evening|at weekends|if needed|and wait|or never|is mine|is wrong|is what they have|was refused|was on the form|had to be shown|appears on it|next week|since June|soon|
helped at once|was kind|was unfriendly|never answered|said no|said it was fine|did the repair|could not do it|has one too|and I am angry|and nobody came|, a nice person|, who knew all|, really|/ no reply|, it stays with us|) and that was all|>|, always|; done|for details|with pictures|as soon as it ships|because of the fault|
bitte|danke|, vielen Dank|und nichts passiert|hat geholfen|war unfreundlich|ab acht|wegen der Lieferung|wurde verlangt|, merci bien|s'il vous plaît|et rien|le soir|a été aimable|pour la facture|por favor|, gracias|y nada|por la noche|fue amable|en la factura|per favore|, grazie mille|
e niente|la sera|è stato gentile|sulla fattura|por favor, obrigado|e nada|à noite|foi simpático|na fatura|alstublieft|, dank u|en niets|'s avonds|was vriendelijk|op de factuur|instead of the shop|or leave it|, over and out|speaking|here|downstairs|upstairs|at the desk|on the line|from support|from the office|last month|years ago|two weeks in a row"""

#: Sentences without personal information; places are filled by rule.
PLAIN = """The {thing} works, but the {thing} rattles.|I like the {thing} because it is light.|After {n} weeks the {thing} broke.|It cost {n} and lasted {n} days.|Bought {n} pieces for the office.|Not worth {n} dollars.|Arrived {n} days late.
Runs at {n} volts and {n} watts.|The dial goes from {n} to {n}.|Dated 2023-{n2}-{n2}.|Made in 20{n2}, sold in 20{n2}.|Takes {n} ml of water.|The {adj} {thing} is my favourite.|My kids love the {thing}.|We use it at home and at work.
{given} liked it too.|My son {given} broke it.|{given} says hello.|Thanks {given}!|We bought it for {given} and she is happy.|a gift for {given}|ask {given}, not me|{given} and {given} share one {thing}.|my daughter {given} uses it|said {given}, and left
The {brand} is better.|{brand} makes good things.|I compared it with {brand}.|Beats {brand} by far.|A {brand} {thing} would be cheaper.|the {brand} was worse|against the {brand} it loses|unlike the {brand} it holds|our old {brand} {thing}|my {brand} fell|than the {brand}|the {brand} and the {brand} are equal|Ein {brand} wäre besser.|Mieux que {brand}.|Mejor que {brand}.|Meglio di {brand}.|Melhor que {brand}.|Beter dan {brand}.
Follow @{word} for news.|@{word}_help answered quickly.|They sit in {place}.|Made near {place}.|A shop in {place} has it.|We drove from {place} to {place}.|In {place} it rains a lot.|the street was loud|a road bike and a garden way|The dot on the screen is at the top.
I looked at the dot and at the line.|Meet at the store.|At noon it stopped.|open from {n} to {n}|Five stars.|Two stars only|Nope|good|so good|Great!!!|awful|Love it|<i>nice</i> &amp; clean|:-)|***|10/10|{n} %|{n}x{n} cm|{n}°|{n} {word}, and {word}|at {n} {word} it stops|a {n} {thing} {thing}|nach {n} {word} und|après {n} {word}, mais|tras {n} {word}, pero|dopo {n} {word}, ma|após {n} {word}, mas|na {n} {word}, maar|Sadly, it broke|Honestly, no|Well, the {thing} leaks|Luckily, my {thing} survived|Then, after {n} {word}, silence|Yesterday, my {thing} fell
Das {thing} ist gut.|Die Farbe gefällt uns nicht.|Nach {n} Tagen war es kaputt.|Wir haben {n} Euro gezahlt.|Leider zu laut und zu schwer.|Passt nicht in den Schrank.|Die Bedienung ist einfach.|Unser Hund mag es.|Meine Frau ist begeistert.|{given} findet es schön.|Schnell geliefert, gut verpackt.
Le produit est beau mais fragile.|Après {n} mois, plus rien.|Nous l'utilisons tous les jours.|Trop cher pour {n} euros.|La couleur plaît à {given}.|Livré vite et bien emballé.|Je le rachèterais.|Très déçu, il est cassé.|Mon fils adore.|Le bruit est énorme.
El producto es bonito pero frágil.|Después de {n} meses no funciona.|Pagamos {n} euros.|A {given} le gusta.|Muy contento con la compra.|No lo recomiendo.|La caja llegó abierta.|Hace mucho ruido.|Lo usamos cada día.
Il prodotto è bello ma fragile.|Dopo {n} mesi non va più.|Costa {n} euro.|A {given} piace molto.|Non lo consiglio a nessuno.|La scatola era aperta.|Fa troppo rumore.|Lo usiamo ogni giorno.
O produto é bonito mas frágil.|Ao fim de {n} meses avariou.|Custou {n} euros.|A {given} gostou.|Não recomendo.|A caixa vinha aberta.|Faz muito barulho.|Usamos todos os dias.
Het product is mooi maar breekbaar.|Na {n} maanden was het stuk.|Het kostte {n} euro.|{given} vindt het leuk.|Niet aan te raden.|De doos was open.|Maakt veel lawaai.|We gebruiken het elke dag.
The colour is not what the picture shows and the {thing} feels cheap.|On the first day the {thing} made a strange noise and then nothing.|I would buy a second {thing} if it were {n} cheaper.|Cleaning takes {n} minutes, drying takes longer.|The manual is short and the {thing} heavy.
Neither the {thing} nor the {thing} fits.|Strong enough for {n} kilos.|Water came in after {n} minutes of rain.|Delivery was quick, packaging poor.|Used it for {n} trips.|The screws are loose again.|One of {n} was broken.|I returned the {adj} one and kept the {adj} one."""
#: What may stand before a code that is no identity number, and what the code looks like.
CODES = """batch|batch number|lot|lot code|serial|serial number|serial no.|S/N|order|order number|order no.|tracking|tracking number|parcel number|invoice|invoice no.|ticket|case|article|item|item no.|model|part number|product code|barcode|EAN|UPC|SKU|ISBN|version|revision|stamp|label|the label says|sticker|on the sticker it says|the box reads|marked|printed below:|code|reference|ref.|coupon|voucher|patent|standard|norm|
Charge|Seriennummer|Bestellnummer|Sendungsnummer|Rechnung|Artikelnummer|auf dem Etikett|Aufdruck|Modell|numéro de lot|numéro de série|commande|suivi|facture|l'étiquette|modèle|lote|número de serie|pedido|seguimiento|factura|la etiqueta|pone|modelo|lotto|numero di serie|ordine|spedizione|fattura|l'etichetta|c'è scritto|modello|número de série|encomenda|rastreio|fatura|a etiqueta|lê-se|batchnummer|serienummer|ordernummer|zending|factuur|het etiket|staat|model"""


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _letters(r: random.Random, n: int) -> str:
    return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))


_ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kn kr l m n p pl pr qu r s sch sh sk sl sm sn sp st str sv t th tr v vl w wh y z".split()
_NUCLEI = "a a e e i i o o u ai au ea ee ei ie oa oo ou y á é í ó ö ü å".split()
_CODAS = ["", "", "", "n", "r", "l", "s", "t", "m", "k", "d", "nd", "rt", "ll", "ck", "lt", "sch", "ng", "st", "rn", "ld", "th", "x", "rd", "nn", "tt"]


def made(r: random.Random, low: int = 1, high: int = 3) -> str:
    """A word that no list holds."""
    return "".join(r.choice(_ONSETS) + r.choice(_NUCLEI) + r.choice(_CODAS) for _ in range(r.randint(low, high)))


class Maker:
    """Fills places from the lists: all of them, or for measuring the four fifths of ``part`` 0 or the fifth of ``part`` 1."""

    def __init__(self, r: random.Random, part: int | None = None, parts: int = 5):
        self.r = r
        mine = lambda xs: [x for i, x in enumerate(xs) if part is None or (i % parts == 0) == bool(part)]
        one = lambda s: mine([x.strip("\n") for x in s.split("|")])
        self.given, self.family, self.nouns = mine(GIVEN), mine(FAMILY), mine(NOUNS)
        self.openings, self.endings = {k: one(v) for k, v in OPENINGS.items()}, one(ENDINGS)
        self.plain, self.codes = mine(PLAIN.replace("\n", "|").split("|")), one(CODES)

    def first(self) -> str:
        return self.r.choice(self.given) if self.r.random() < 0.6 else made(self.r, 1, 2).capitalize()

    def last(self) -> str:
        one = lambda: self.r.choice(self.family).replace("~", " ") if self.r.random() < 0.45 else made(self.r, 2, 3).capitalize()
        return one() + (f"-{one()}" if self.r.random() < 0.1 else "")

    def name(self) -> str:
        x = self.r.random()
        if x < 0.12:
            return f"{self.last()}, {self.first()}"
        if x < 0.3:
            return f"{self.first()} {_letters(self.r, 1)}. {self.last()}"
        return f"{self.first()} {self.first()} {self.last()}" if x < 0.34 else f"{self.first()} {self.last()}"

    def email(self) -> str:
        r, d = self.r, lambda n: _digits(self.r, n)
        g, f = self.first().lower(), self.last().lower().replace(" ", "").replace("'", "")
        user = r.choice([f"{g}.{f}", f"{g}_{f}", f"{f}-{g}", f"{g}{f}", f"{g}{d(2)}", f"{g}{d(4)}", f"{f}.{d(3)}", f"{g[0]}{f}", f"{g[0]}.{f}", f"{g[0]}_{f}", f"{r.choice(self.nouns)}.{r.choice(self.nouns)}", f"{g[0]}.{f}{d(4)}", f"{g}-{f}{d(1)}", f"{g}+{r.choice(self.nouns)}", f"{g}+{r.choice(self.nouns)}{d(1)}", r.choice(["info", "sales", "help", "office"]), f"{g}.{g[0]}.{f}"])
        host = "".join(r.choice([made(r, 1, 2), r.choice(self.nouns), made(r, 2, 2)]) for _ in range(r.choice([1, 1, 2]))) if r.random() < 0.6 else f"{made(r, 1, 2)}{r.choice(['.', '-', '.'])}{r.choice([made(r, 1, 2), r.choice(self.nouns)])}"
        host += "." + r.choice(TLDS)
        plain, spelt = f"{user}@{host}", host.replace(".", " dot ")
        return r.choice([plain] * 6 + [f"{user} @ {host}", f"{user}(at){host}", f"{user} (at) {host}", f"{user}[at]{host}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user} at {spelt}", f"{user} at {spelt}", f"{user.replace('.', ' dot ')} at {spelt}", f"{user} (at) {host.replace('.', ' (dot) ')}", f"{user} AT {host.replace('.', ' DOT ')}", f"{user} at {host}"])

    def phone(self) -> str:
        r, d = self.r, lambda n: _digits(self.r, n)
        a, s = f"{r.randint(2, 9)}{d(2)}", r.choice([" ", "-", ".", " ", ""])
        pairs = lambda n: s.join(d(2) for _ in range(n))
        return r.choice([
            f"+1 {a} {d(3)} {d(4)}", f"+1-{a}-{d(3)}-{d(4)}", f"({a}) {d(3)}-{d(4)}", f"{a}-{d(3)}-{d(4)}", f"{a}.{d(3)}.{d(4)}", f"{a} {d(3)} {d(4)}", f"{a}{d(7)}", f"1-800-{d(3)}-{d(4)}", f"07{d(3)} {d(6)}", f"07{d(3)} {d(3)} {d(3)}", f"07{d(9)}", f"+44 7{d(3)} {d(6)}", f"+447{d(9)}", f"020 {d(4)} {d(4)}", f"01{d(3)} {d(6)}", f"+44 20 {d(4)} {d(4)}",
            f"+33 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.randint(1, 9)}{s}{pairs(4)}", f"+33{s}{r.randint(1, 9)}{s}{pairs(4)}", f"+49 (0){d(2)} {d(5)} {d(3)}", f"+49 {d(3)} {d(7)}", f"+49 {d(2)} {d(5)}{d(3)}", f"0049-{d(2)}-{d(8)}", f"0049 {d(3)} {d(7)}", f"0{d(3)} {d(8)}", f"0{d(2)} {d(8)}", f"0{d(2)}/{d(5)} {d(3)}", f"0{d(3)}/{d(6)}",
            f"6{d(2)} {d(3)} {d(3)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"9{d(2)} {d(3)} {d(3)}", f"+39 3{d(2)} {d(3)} {d(4)}", f"3{d(2)} {d(7)}", f"+351 9{d(2)} {d(3)} {d(3)}", f"06-{d(8)}", f"06 {d(8)}", f"+31 6 {d(8)}", f"+47 {d(3)} {d(2)} {d(3)}", f"+{d(2)} {d(2)} {d(3)} {d(4)}",
        ])

    def address(self) -> str:
        r, n, x = self.r, self.r.randint(1, 260), self.r.random()
        road = lambda: r.choice([self.last().split(" ")[-1], made(r, 1, 3).capitalize(), r.choice(self.nouns).capitalize(), self.last().split("-")[0]])
        place = r.choice(PLACES) if r.random() < 0.3 else made(r, 2, 3).capitalize() if r.random() < 0.7 else f"{r.choice(['Bad', 'San', 'Saint', 'North', 'New', 'Port'])} {made(r, 1, 2).capitalize()}" if r.random() < 0.5 else f"{made(r, 2, 2).capitalize()} {r.choice(['Bay', 'Hill', 'Park', 'Lake'])}"
        if x < 0.45:
            head = r.choice([f"Flat {r.randint(1, 40)}, ", f"Apt {r.randint(1, 40)}, ", f"Unit {r.randint(1, 40)}, "]) if r.random() < 0.3 else ""
            return head + f"{n}{r.choice(['', '', '', 'A', 'b'])} {road()}{' ' + road() if r.random() < 0.1 else ''} {r.choice(ROADS)}" + (f", {place}" if r.random() < 0.5 else "")
        if x < 0.65:
            return f"{road()}{r.choice(WAYS)} {n}{r.choice(['', '', 'a'])}" + (f", {_digits(r, r.choice([4, 5, 5, 5]))} {place}" if r.random() < 0.65 else f", {place}" if r.random() < 0.3 else "")
        if x < 0.82:
            of = r.choice(OF)
            return f"{n} {r.choice(STREETS)} {of}{'' if of.endswith(chr(39)) or not of else ' '}{road()}{' ' + road() if r.random() < 0.45 else ''}" + (f", {place}" if r.random() < 0.6 else f", {_digits(r, 5)} {place}" if r.random() < 0.3 else "")
        of = r.choice(["", "", "de ", "del ", "della ", "dos ", "da "])
        return f"{r.choice(CALLES)} {of}{road()} {n}" + (f", {r.randint(1, 9)}º {r.choice('ABCD')}" if r.random() < 0.5 else f", {place}" if r.random() < 0.5 else "")

    def identity(self, form: str) -> str:
        r, d, s = self.r, lambda n: _digits(self.r, n), self.r.choice([" ", "-", "", "-"])
        if form == "ssn":
            return f"{d(3)}{s}{d(2)}{s}{d(4)}"
        if form == "nino":
            s = r.choice([" ", ""])
            return f"{_letters(r, 2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{r.choice('ABCD')}"
        if form == "tax":
            return r.choice([f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), f"{d(3)}/{d(3)}/{d(5)}", f"{d(2)} {d(2)} {d(3)} {d(3)} {d(3)}", d(13), f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)}-{d(7)}", d(9), f"{d(8)}{_letters(r, 1)}", f"{_letters(r, 1)}{d(7)}{_letters(r, 1)}", f"{_letters(r, 6)}{d(2)}{_letters(r, 1)}{d(2)}{_letters(r, 1)}{d(3)}{_letters(r, 1)}", f"{d(3)} {d(3)} {d(3)}"])
        return r.choice([f"{_letters(r, 2)}{d(7)}", f"{_letters(r, 2)} {d(7)}", f"{_letters(r, 1)}{d(8)}", f"{_letters(r, 1)}{d(7)}", d(9), f"{d(2)}{_letters(r, 2)}{d(5)}", f"C{_letters(r, 1)}{d(2)}{_letters(r, 2)}{d(3)}", f"{_letters(r, 3)}{d(6)}"])

    def brand(self) -> str:
        r = self.r
        return r.choice([f"{r.choice(ADJECTIVES).capitalize()} {r.choice(self.nouns).capitalize()}", f"{made(r, 1, 2).capitalize()} {r.choice(self.nouns).capitalize()}", f"{r.choice(ADJECTIVES).capitalize()} {made(r, 1, 2).capitalize()}", made(r, 2, 3).capitalize(), f"{r.choice(self.nouns)}{r.choice(self.nouns)}".capitalize()])

    def code(self) -> str:
        r, d, c = self.r, lambda n: _digits(self.r, n), lambda n: _letters(self.r, n)
        return r.choice([f"{c(2)}{d(6)}{c(1)}", f"{c(2)}{d(6)}{c(1)}", f"{c(1)}{d(7)}", f"{c(2)}{d(6)}", d(6), d(7), d(8), d(9), d(10), d(12), d(13), f"{d(3)}-{d(7)}-{d(7)}", f"{d(4)}-{d(3)}-{d(3)}", f"{d(4)}-{d(3)}-{d(4)}", f"{d(4)}-{d(3)}-{d(4)}/{c(1)}", f"1Z{d(3)}{c(2)}{d(11)}", f"{d(1)}{c(1)}{d(3)}{c(1)}{d(8)}", f"{c(2)}-{d(4)}", f"{d(1)}.{d(2)}.{d(3)}", f"{c(2)} {d(3)}-{d(1)}", f"{c(2)} {d(3)}-{d(1)}:20{d(2)}", f"{c(3)}{d(5)}{c(1)}", f"#{d(8)}", f"{d(4)}-{d(3)}"])

    def amount(self) -> str:
        return str(self.r.randint(1, 420) if self.r.random() < 0.6 else int(2 ** self.r.uniform(0, 9)))

    def filler(self) -> str:
        """Words in small letters, known and made up, with a number here and there, as in any language."""
        r = self.r
        words = [r.choice(LITTLE) if r.random() < 0.45 else r.choice(self.nouns) if r.random() < 0.3 else made(r, 1, 3) for _ in range(r.randint(4, 10))]
        if r.random() < 0.5:
            words[r.randrange(1, len(words))] = self.amount()
        if r.random() < 0.4:
            k = r.randrange(0, len(words) - 1)
            words[k] += ","
        if r.random() < 0.25:
            words[r.randrange(1, len(words))] = made(r, 1, 3).capitalize() if r.random() < 0.4 else f"the {self.brand()}"
        return " ".join([words[0].capitalize(), *words[1:]]) + r.choice([".", ".", "", "!"])

    def plain_sentence(self) -> str:
        r = self.r
        if r.random() < 0.4:
            return self.filler()
        if r.random() < 0.3:
            lead = r.choice(self.codes) + (r.choice([" number", " no.", " Nr.", " code", " n°"]) if r.random() < 0.2 else "")
            return f"{lead if r.random() < 0.5 else lead[:1].upper() + lead[1:]}{r.choice([' ', ' ', ': ', ' is '])}{self.code()}{r.choice(['', '', '.', ' ' + r.choice(self.endings).lstrip(')>')])}"
        s = r.choice(self.plain)
        for key, f in (("thing", lambda: r.choice(self.nouns) if r.random() < 0.6 else made(r, 1, 3)), ("n2", lambda: str(r.randint(10, 12))), ("n", self.amount), ("adj", lambda: r.choice(ADJECTIVES)), ("given", self.first), ("brand", self.brand), ("word", lambda: made(r, 2, 3)), ("place", lambda: r.choice(PLACES) if r.random() < 0.4 else made(r, 2, 3).capitalize())):
            while f"{{{key}}}" in s:
                s = s.replace(f"{{{key}}}", f(), 1)
        return s

    def framed(self, kind: str) -> list[tuple[str, str]]:
        r, label = self.r, "id_number" if kind in ("ssn", "nino", "tax", "pass") else kind
        text = self.identity(kind) if label == "id_number" else getattr(self, kind)()
        if label in ("name", "address"):
            x = r.random()
            text = text.lower() if x < 0.14 else text.upper() if x < 0.26 else text
        lead, end = "", r.choice(self.endings)
        if label == "id_number" or r.random() > 0.1:
            lead = r.choice(self.openings[kind])
            if label != "id_number" and r.random() < (0.4 if label != "name" else 0.15):  # in a place that no list foresees
                lead = " ".join(self.filler().rstrip(".!,").split(" ")[:3]).lower()
            if r.random() < 0.5:
                lead = lead[:1].upper() + lead[1:]
            if r.random() < 0.25:
                lead = " ".join(self.plain_sentence().rstrip(".!?").split(" ")[-3:]) + " " + lead
        gap = "" if not lead or lead[-1] in "(</=:~" and r.random() < 0.8 or lead.endswith("mailto:") else " "
        if label == "id_number" and r.random() < 0.3:
            gap = r.choice([": ", " is ", ", ", " no. "]) if lead[-1] not in ".:" else " "
        if end and end[0] not in ".,!;)/>":
            end = " " + end
        if lead.endswith("(") and not end.startswith(")"):
            end = ")" + end
        if lead.endswith("<") and not end.startswith(">"):
            end = ">" + end
        return [(lead + gap, ""), (text, label), (end, "")]


#: How often each kind of place is drawn.
DRAW = ["email"] * 4 + ["phone"] * 7 + ["ssn", "nino", "tax", "pass"] * 3 + ["address"] * 5 + ["name"] * 9


def examples(n: int = 6000, seed: int = 7, part: int | None = None) -> list[list[tuple[str, str]]]:
    """``n`` labelled texts of one to four sentences, each a list of (stretch, kind or '')."""
    r = random.Random(seed)
    m, out = Maker(r, part), []
    for k in range(n):
        parts: list[tuple[str, str]] = []
        for _ in range(r.choice([1, 2, 2, 3, 4])):
            parts += [(r.choice([" ", " ", " ", "\n", ". "]), "")] if parts else []
            parts += m.framed(r.choice(DRAW)) if r.random() < 0.5 else [(m.plain_sentence(), "")]
        if r.random() < 0.03:
            parts += [(" ", ""), (m.name(), "name"), (r.choice([", ", " / ", " "]), ""), *m.framed(r.choice(["phone", "address", "email"]))[1:]]
        x = r.random()
        out.append([(a.lower() if x < 0.08 else a.upper() if x < 0.16 else a, b) for a, b in parts if a])
    return out
