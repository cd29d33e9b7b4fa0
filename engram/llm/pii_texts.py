"""Labelled texts to train the tagger on: phrasings of three languages, public formats of many countries, and decoys.

Nothing here is read off the texts that the tagger is run on. Phrases are written down with slots, slots are filled by
makers of values, and what surrounds a phrase is a background of other sentences without personal information.
"""

from __future__ import annotations

import numpy as np

EMAIL, PHONE, ID, ADDRESS, NAME = range(5)

#: Frequent family names and characters of given names of Chinese; public knowledge.
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
HAN_DOUBLE = ("欧阳", "司马", "上官", "诸葛", "东方", "慕容")
HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰红建国文志海峰云龙天宇浩然子轩雨欣佳怡思远晨曦嘉豪梓涵诗琪俊熙若楠小晓春燕冬梅秋月永康立新宏达书瑶景行一鸣可心安琪博雅清源宝珍凤莲福贵长顺德胜"
#: Given names as they are spoken in several countries; the table of name parts is added to them.
GIVEN = "Sarah Michael Priya Kenji Piotr Maria Ahmed Fatima Carlos Lucia Ivan Olga Hans Greta Jean Claire Giulia Marco Ingrid Lars Aisha Kwame Chloe Liam Noah Emma Sofia Mateo Yuki Haruto Ananya Rahul Zeynep Emre Katarzyna Tomasz Eva Petr Björn Søren Jürgen Käthe Élodie François José Inés Seán Niamh Wei Ming Jun David Laura Peter Anna Thomas Julia Robert Helen James Ruth Daniel Susan Paul Karen".split()
FAMILY = "Connor Garcia Lopez Watanabe Nowak Smith Johnson Müller Schmidt Schneider Weber Dubois Moreau Rossi Bianchi Silva Santos Ivanov Petrov Kowalski Nguyen Tran Kim Park Patel Singh Khan Hassan Okafor Mensah Andersson Jensen O'Brien McCarthy MacDonald Yılmaz Novák Horváth Tanaka Suzuki Fernández Álvarez Lefèvre Björk Brown Taylor Wilson Clark Walker Young King Wright Hall Baker Carter Fischer Wagner Becker Hoffmann Koch Richter Wolf".split()
PARTICLES = ("van", "von", "de", "da", "van der", "von der", "di", "le", "al")
NATURE = "Oak Maple Cedar Elm River Lake Hill Mill Church Park Station Victoria Albert King Queen Market Bridge Garden Meadow Spring Forest High Main Castle Abbey Orchard Willow Rose Kings Chestnut Harbour Baker Fleet Wellington Washington Lincoln Franklin Sunset Highland Valley Prospect Union Grove Ash Birch Linden Juniper Heron Quarry Priory Vicarage Cobbler Tanner Saddler Brookside Stonegate".split()
EN_TYPES = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Court Ct Way Place Pl Row Close Terrace Crescent Boulevard Blvd Square Sq Hill Grove Mews Walk Gardens Park Parade Quay Circle Parkway".split()
DE_STEMS = "Schiller Goethe Haupt Bahnhof Kirch Garten Wald Berg Linden Eichen Rosen Mozart Beethoven Schul Mühlen Wiesen Dorf Feld Burg Markt Neu Alt Brunnen Sonnen Bach Birken Hafen Ufer Post Ring Friedrich Wilhelm Blumen Amsel Tannen Kastanien Färber Gerber Salz Weber".split()
DE_ENDS = "straße strasse str. weg gasse allee platz ring damm ufer hof garten berg steig pfad zeile winkel graben markt wall kamp grund".split()
DE_PLACES = "Markt Mühle Hafen Bahnhof Wald Bach See Kirche Stadtpark Rathaus Weiher Anger Sportplatz Deich Wehr Tor Hang Graben".split()
HAN_ROADS = "中山人民解放建设和平长江黄河文化新华学院青年光明花园桃源清溪凤凰金桂银杏梧桐望江北辰南湖东风西苑春晓秋实紫竹翠屏"
WORDS = "blue fast night core data lab shop mail info team sales support dev cloud north green river stone letter office home studio press note post work desk".split()
TLDS = "com org net io de cn co.uk eu info app dev edu example test invalid fr jp in".split()


class Maker:
    """Values of every kind, and things that only look like them."""

    def __init__(self, parts: list[tuple[str, str]], rng: np.random.Generator) -> None:
        self.rng = rng
        self.given = GIVEN + 2 * [t for t, r in parts if r == "given" and t.isascii()]
        self.family = FAMILY + [t for t, r in parts if r == "family" and t.isascii()]
        self.han_family = list(HAN_FAMILY) + [t for t, r in parts if r == "family" and not t.isascii()]

    def pick(self, of):
        return of[int(self.rng.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def filled(self, form: str) -> str:
        """# a digit, % a digit that isn't 0, @ a capital."""
        return "".join(self.digits(1) if c == "#" else str(int(self.rng.integers(1, 10))) if c == "%" else chr(65 + int(self.rng.integers(26))) if c == "@" else c for c in form)

    def invented(self, syllables: tuple[int, int] = (2, 4)) -> str:
        onset, vowel, coda = "b c d f g h j k l m n p r s t v w z br dr gr kr st th sh ch fl gl pl".split(), "a e i o u a e i o ai ea ie oo".split(), "n l r s t m ck nd rd th st rn ".split(" ")
        return "".join(self.pick(onset) + self.pick(vowel) + (self.pick(coda) if self.chance(0.5) else "") for _ in range(int(self.rng.integers(*syllables)))).capitalize()

    def surname(self) -> str:
        one = lambda: self.pick(self.family) if self.chance(0.5) else (self.invented() + self.pick("son man ley ton field er berg ski sen wood mark stad wick ham beck".split()) if self.chance(0.6) else self.invented())
        s = one()
        if self.chance(0.1):
            s += "-" + one()
        if self.chance(0.04):
            s = self.pick(PARTICLES) + " " + s
        return s

    def first(self) -> str:
        g = self.pick(self.given) if self.chance(0.75) else self.invented((2, 3))
        return g + "-" + self.pick(self.given) if self.chance(0.04) else g

    def name(self) -> str:
        r = self.rng.random()
        g, f = self.first(), self.surname()
        if r < 0.50:
            s = f"{g} {f}"
        elif r < 0.60:
            s = f"{f}, {g}"
        elif r < 0.70:
            s = f"{g[0]}. {f}"
        elif r < 0.78:
            s = f"{g} {chr(65 + int(self.rng.integers(26)))}. {f}"
        elif r < 0.85:
            s = f"{g} {self.first()} {f}"
        elif r < 0.89:
            s = f"{f}, {g[0]}."
        elif r < 0.92:
            s = f"{f} {g}"
        else:
            s = f"{g} {f}".upper() if self.chance(0.6) else f"{f}, {g}".upper()
        return s

    def han_name(self, alone: bool = False) -> str:
        f = self.pick(HAN_DOUBLE) if self.chance(0.04) else self.pick(self.han_family)
        return f + "".join(self.pick(HAN_GIVEN) if self.chance(0.8) else chr(int(self.rng.integers(0x4E00, 0x9000))) for _ in range(int(self.rng.integers(0 if alone else 1, 3))))

    def email(self) -> str:
        a, b = self.first().lower(), self.surname().lower().replace(" ", "")
        local = self.pick([f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", a[0] + b, f"{a}{b}", f"{b}{self.digits(2)}", f"{a}.{b}+{self.pick(WORDS)}", f"{a[0]}.{b}", self.pick(WORDS), f"{a}{self.digits(3)}", f"{b}.{a[0]}"])
        host = self.pick([self.pick(WORDS), self.pick(WORDS) + self.pick(WORDS), f"{self.pick(WORDS)}-{self.pick(WORDS)}", f"{self.pick('mail mx eu web corp us intra'.split())}.{self.pick(WORDS)}", self.invented().lower()])
        host += "." + self.pick(TLDS)
        local = "".join(c for c in local if c.isascii() and (c.isalnum() or c in "._+-")) or "info"
        r = self.rng.random()
        if r < 0.72:
            s = f"{local}@{host}"
        elif r < 0.79:
            s = f"{local} at {host.replace('.', ' dot ')}"
        elif r < 0.85:
            s = f"{local}(at){host.replace('.', '(dot)')}"
        elif r < 0.91:
            s = f"{local} [at] {host.replace('.', ' [dot] ')}" if self.chance(0.5) else f"{local}[at]{host}"
        else:
            s = f"{local}＠{host}"
        return s.upper() if self.chance(0.06) else s

    PHONES = (
        "(%##) ###-####", "%##-###-####", "%##.###.####", "%## ### ####", "+1 %## ### ####", "+1-%##-###-####", "1-%##-###-####", "+1 (%##) ###-####", "001 %## ### ####", "%#########",
        "0%## #### ####", "0%### ######", "07### ######", "07### ### ###", "+44 7### ######", "+44 %# #### ####", "+44 (0)%# #### ####", "0044 %### ######", "(0%#) #### ####", "07#########",
        "0%# ########", "0%##/#######", "0%## ######", "+49 %## #######", "+49 (0)%# ########", "0049 %# #######", "0%## - #######", "(0%#) #####-##", "(0%#) ##### ###", "01## #######", "+49 1## ########", "0%#/#####-###",
        "1%#########", "1%# #### ####", "1%#-####-####", "+86 1%# #### ####", "+86-1%#########", "86 1%# #### ####", "0%#-########", "0%##-########", "0%##-#######", "(0%##)########", "(0%##) #### ####", "0%## ########",
        "0% ## ## ## ##", "0%.##.##.##.##", "+33 % ## ## ## ##", "+33 (0)% ## ## ## ##", "+34 %## ### ###", "%## ## ## ##", "+39 0% #### ####", "+39 3## ### ####", "+91 %#### #####", "+91-%#########", "%#### #####",
        "+81 3-####-####", "03-####-####", "090-####-####", "+82 10-####-####", "+61 4## ### ###", "04## ### ###", "+55 11 9####-####", "+48 %## ### ###", "+31 6 ########", "+46 7#-### ## ##", "+7 9## ###-##-##", "+971 5# ### ####", "+353 8# ### ####",
    )

    def phone(self) -> str:
        return self.filled(self.pick(self.PHONES))

    IDS = (
        "###-##-####", "###-##-####", "### ## ####", "#########", "@@ ## ## ## @", "@@######@", "@@######@", "@########", "@########", "%########", "@@#######", "@#######", "@@@######", "%##########", "## ### ### ###", "## ### ### ###",
        "@%@#####%", "@##@#@###", "@@%##@#@%", "%#####19%#######", "%#####19####%%#X", "%#####19%#########", "%#####19##%%%####", "%#####20########", "%##### 19###### ####", "%##### 19%##### ###X", "########@", "########-@", "@-#######-@", "% ## ## ## ### ### ##", "#### #### ####", "%###########",
        "###.###.###-##", "%#.###.###-#", "@@@@@@##@##@###@", "######-####", "######/####", "@#########", "### ### ###", "##-#######",
    )

    def identity(self) -> str:
        s = self.filled(self.pick(self.IDS))
        if self.chance(0.25):  # Chinese numbers are the longest, and must be seen often
            day = f"{int(self.rng.integers(1940, 2015))}{int(self.rng.integers(1, 13)):02d}{int(self.rng.integers(1, 29)):02d}"
            a, c = self.filled("%#####"), self.filled("###") + self.pick("0123456789X")
            s = f"{a} {day} {c}" if self.chance(0.25) else a + day + c
        return s

    def number(self) -> str:
        n = str(int(self.rng.integers(1, 10 ** int(self.rng.integers(1, 4)) + 9)))
        return n

    def address(self) -> str:
        n, r = self.number(), self.rng.random()
        if r < 0.6:
            n += self.pick("ABCDEF") if self.chance(0.15) else f"-{int(n) % 90 + 2}" if self.chance(0.12) else self.pick("abc") if self.chance(0.08) else ""
            s = self.pick(NATURE) if self.chance(0.5) else self.invented() + self.pick(["", "field", "gate", "side", "hall", "bury", "ton", "pit", "wood"])
            s = self.pick(["N. ", "S. ", "W. ", "E. ", "Old ", "New ", "Upper ", "Great ", "Saint "]) + s if self.chance(0.2) else s + " " + self.pick(NATURE) if self.chance(0.08) else s
            return f"{n} {s} {self.pick(EN_TYPES)}" + ("." if self.chance(0.02) else "")
        if r < 0.85 or self.chance(0.3):
            n += self.pick(["a", "b", "c", " a", " b", ""]) if self.chance(0.35) else f"-{int(n) % 90 + 2}" if self.chance(0.1) else ""
            q = self.rng.random()
            if q < 0.65:
                s = (self.pick(DE_STEMS) if self.chance(0.7) else self.invented()) + self.pick(DE_ENDS)
            elif q < 0.85:
                s = self.pick("Am An-der Im Zum Zur Auf-dem In-der Hinter-dem Beim".split()).replace("-", " ") + " " + (self.pick(DE_PLACES) if self.chance(0.7) else self.invented())
            else:
                s = self.pick("Alte Neue Obere Untere Große Kleine Lange".split()) + " " + self.pick(DE_STEMS) + self.pick(("straße", "gasse", "allee"))
            return f"{s} {n}"
        k = self.pick(
            [f"{n} {self.pick(['Rue', 'rue', 'avenue', 'Boulevard', 'place', 'quai', 'chemin', 'impasse'])} {self.pick(['de la ', 'du ', 'de ', 'des ', ''])}{self.invented()}", f"{self.pick(['Calle', 'Avenida', 'Plaza', 'Paseo'])} {self.pick(['de ', 'del ', ''])}{self.invented()} {n}",
             f"{self.pick(['Via', 'Viale', 'Corso', 'Piazza'])} {self.invented()} {n}", f"{self.invented()}{self.pick(['gracht', 'straat', 'laan', 'weg', 'gatan', 'vej', 'gade'])} {n}", f"ul. {self.invented()} {n}", f"{self.pick(['Rua', 'Avenida'])} {self.pick(['da ', 'dos ', ''])}{self.invented()} {n}"]
        )
        return k

    def han_address(self) -> str:
        s = "".join(self.pick(HAN_ROADS) for _ in range(int(self.rng.integers(1, 4)))) if self.chance(0.5) else "".join(chr(int(self.rng.integers(0x4E00, 0x9000))) for _ in range(int(self.rng.integers(1, 4))))
        s += self.pick(["", "", "东", "西", "南", "北", "中"]) + self.pick("路 路 街 巷 里 弄 大道 大街 胡同 坊 道 支路".split())
        n = self.number()
        return s + n + (self.pick("-之") + str(int(self.rng.integers(1, 20))) if self.chance(0.2) else "") + "号"

    def handle(self) -> str:
        """What has an @ and is no address."""
        w = self.invented((1, 3)).lower() if self.chance(0.6) else self.pick(WORDS)
        v = f"{self.pick('0 1 2 3 5 10'.split())}.{self.digits(1)}.{self.digits(1)}"
        return self.pick([f"@{w}", f"@{w}{self.pick(WORDS)}", f"{w}@{v}", f"{w}@^{v}", f"{self.pick('root deploy admin git build ci'.split())}@{w}-{self.digits(2)}", f"{self.pick('root deploy admin'.split())}@{w}", f"{w}@{self.digits(3)}", f"@{w}/{self.pick(WORDS)}", f"{w}-{self.pick(WORDS)}@{v}"])

    def product(self) -> str:
        r = self.rng.random()
        if r < 0.25:
            return self.invented()
        if r < 0.33:
            return self.filled("@@@@@@"[: int(self.rng.integers(2, 7))])
        if r < 0.5:
            return "".join(self.invented((1, 2)) for _ in range(3))
        if r < 0.8:
            return self.pick(NATURE) + " " + self.invented()
        return self.pick(["Project ", "Team ", "Operation ", ""]) + self.invented() + self.pick([" Cloud", " Suite", "Hub", "-agent", " Labs", "DB", " Street dataset"])

    DECOYS = ("order #########", "order no. ##########", "build %####", "build number %#######", "ticket #######", "ticket %####", "v%.##.#", "version %.#.##", "port %###", "row %######", "rows %####### to %#######", "at 1#:## today", "2024-0%-1#", "epoch 17########", "timestamp 17###########", "commit %######", "trace id %#########", "#%####", "Auftrag ########", "Auftragsnummer %######", "Zeitstempel 17########", "Version %.#", "Ticket %#####", "订单号##########", "订单%########", "工单%#####", "版本%.#.#", "端口%###", "时间戳17########", "构建编号%######", "单号%####", "第%###行", "tracking number ############", "SKU ########", "invoice %######", "serial @@%#######", "batch %#####", "job %########", "sample %########", "checksum %#########", "host 10.%#.#.#", "%##### of the records", "Rechnung %#######", "Seriennummer @#######", "快递单号@@##########", "流水号%###########", "批次%#####", "(#%####)", "(#%###)", "issue #%##", "v%#.%##", "v%.%#", "v0.%##", "build %#", "build %##", "% MB", "%## GB", "%## ms", "%#%", "%# Prozent", "%## Einträge", "%## hours", "rows %##-###-####", "cells %##-%##-####", "range %###-%###", "columns %#-%##", "Auftrag %#########", "order %#########", "offset %##.%##.####", "Zeilen %##/%#####", "（单号%####）", "#%####", "%##项", "pid %####", "id=%#######", "ref %####", "Ref %####.", "percent %#", "sha %@#@#@#@#", "uptime %######", "seed %#########")

    def decoy(self) -> str:
        return self.filled(self.pick(self.DECOYS))


#: Phrases by language. N a name, T a name after a title (family name or whole), Z a Chinese name, Y one before 先生 or 女士, E an email address, P a phone
#: number, I an identity number, A an address, C a Chinese one; G a given name alone, X a product, H a handle and D a number, which are no findings.
ENGLISH = """Please contact {N} about the contract|You can ask {N} for the details|I spoke with {N} this morning|{N} will join the review|{N} signed the form|Our new colleague {N} starts on Monday|The account belongs to {N}|Reported by {N}|Author: {N}|Name: {N}|name={N}|Customer {N} complained twice|The owner is {N}|my sister {N} lives there|cc {N}|Thanks to {N} and {N}|Meeting with {N} at noon|Tell {N} that it is done|signed: {N}|{N} wrote the first draft|{N} called back|assigned to {N}|I met {N} in the lobby|Regards, {N}|It was {N} who found it|the tenant, {N}, moved out|Interview with {N}|employee: {N}|full name: {N}|ask for {N} at the desk|Remember that {N} has a key|contact person is {N}|on behalf of {N}|
Mr. {T} called|Mrs. {T} agreed|Ms. {T} is away|Dr. {T} approved it|Prof. {T} reviewed the paper|Miss {T} left a note|Dear Mr {T},|Mr {T} and Dr {T} disagree|according to Dr. {T}|Sir {T} opened it|Professor {T} retired|
Write to {E}|Send it to {E} please|my address is {E}|email: {E}|mail {E} today|E-mail: <{E}>|reach us at {E}|mailto:{E}|contact={E}|forwarded from {E} yesterday|{E} bounced again|user {E} was locked out|The invoice goes to {E}, not to me|Reply-To: {E}|copied {E} on it|sign in as {E}|
Call {P}|tel={P}|fax={P}|mobile={P}|{P} rings at the front desk|The number is {P}, evenings only|the phone at home is {P}|Call me on {P} after six|phone: {P}|tel. {P}|Tel: {P}|my number is {P}|mobile {P}|You can reach {N} at {P}|reach me under {P}|ring {P} ext. 12|fax {P}|{N}, {P}, {E}|Text {P} when you arrive|WhatsApp {P}|the hotline is {P}|her cell is {P}|phone={P}|dial {P} and wait|office: {P}|{P} is my direct line|we agreed on {P}|try {P} first|they answer on {P}|the front desk uses {P}|night shift {P}|voicemail at {P}|{P} works best|
His SSN is {I}|The SSN no. is {I}|my social security number: {I}|{I} is the passport number|the licence number is {I}|gave {I} as the tax number|the form says ssn: {I}|insurance no. {I}|field passport={I}|Her SSN was recorded as {I}|SSN: {I}|ssn={I}|social security number {I}|passport number {I}|passport {I}|passport no. {I} expires soon|Passport: {I}|national insurance number {I}|NI number: {I}|tax id {I}|TIN {I}|driver's licence {I}|ID card {I}|identity number: {I}|insurance number {I} is on file|his national id, {I}, leaked|They noted {I} as the passport number|personal id {I}|Aadhaar {I}|they quoted {I} as the SSN|she gave {I} as her social security no.|he typed {I} as the national insurance number|{I} as a passport no.|DNI {I}|
She lives at {A}|They moved to {A} in May|Ship it to {A}|Address: {A}|delivered to {A}, flat 4|The office is at {A}, 2nd floor|Deliver to {A} and ring twice|{A}, Springfield|home address {A}|from {A} to {A}|meet me at {A}|a flat in {A}|parcel for {N}, {A}|billing address: {A}|we left {A} last year|
order shipped, see {D}|{D} was refunded|failed in {D}|see {D} for more|Ask {G}|{G} said yes|thanks, {G}!|{X} crashed again|{X} replaced {X}|the {X} team|deploy {X} with {D}|{G} likes {X}|Mark the task as done|I hope this works|Will it rain|a rose garden|Grace period ends|{X} is written by nobody|restart {X} on {D}|between {D} and {D}|pinned {H}|installed {H} again|{H} rejected the key|{H} please rerun|ssh {H} failed|see {H}|on the host for {X}|for {X}|Lately, {X} stopped|In short, {X} was slow|{X} and {X} agree|limit of {D}|since {D}|release {D}|{X} {D}|done. {D}|({D})|{X} reloaded|the {X} Street dataset"""
GERMAN_PHRASES = """Bitte {N} fragen|{N} hat angerufen|Ich habe mit {N} gesprochen|Ansprechpartner: {N}|Name: {N}|Kunde {N} wartet|der Vertrag von {N}|{N} kommt morgen|unterschrieben von {N}|Gruß, {N}|meine Kollegin {N}|Verantwortlich ist {N}|Termin mit {N}|an {N} weitergeleitet|gezeichnet {N}|Mieter {N}|Laut {N} ist alles fertig|
Herr {T} ist krank|Frau {T} meldet sich|Sehr geehrter Herr {T},|Dr. {T} stimmt zu|Prof. {T} prüft das|mit Herrn {T} abgesprochen|Frau Dr. {T} kommt|
Schreib an {E}|E-Mail: {E}|Mail an {E} genügt|erreichbar unter {E}|Antwort bitte an {E}|Kontakt: {E}|
Telefon: {P}|Tel. {P}|Ruf mich unter {P} an|erreichbar unter {P}|Handy {P}|Mobil: {P}|Durchwahl {P}|Rückruf {P}|Mobil {P} ab neun|unter {P} ist jemand da|SMS an {P}|Bereitschaft {P}|am besten {P}|Meine Nummer ist {P}|Rückfragen an {P}|Fax {P}|
Steuer-ID: {I}|Steuernummer {I}|Ausweisnummer {I}|Personalausweis {I}|Reisepass Nr. {I}|Sozialversicherungsnummer {I}|die Nummer des Ausweises lautet {I}|Versichertennummer: {I}|Passnummer {I}|
wohnt in der {A}|Adresse: {A}|Anschrift: {A}|Lieferung an {A}|zieht um nach {A}|Treffpunkt {A}, Hinterhof|Paket an {N}, {A}|Das Büro liegt {A}|Rechnung an {A}, 3. Stock|Die Wohnung {A} ist frei|
{D} ist erledigt|{D} ist offen|bei {D}|{H} meldet sich|Der Datensatz {X} fehlt|die Liste {X}straße fehlt|siehe {D}|{X} ist ausgefallen|{G} weiß Bescheid|{X} läuft auf {D}|Frag {G}|Die {X} Umgebung|Der Dienst brauchte {D}"""
CHINESE_PHRASES = """联系人：{Z}|联系人是{Z}|负责人：{Z}|姓名：{Z}|姓名{Z}|请找{Z}确认|我跟{Z}聊过了|{Z}昨天来过|由{Z}签字|这是{Z}的申请|同事{Z}请假了|转给{Z}处理|作者{Z}|客户{Z}投诉了|收件人：{Z}|经办人{Z}|{Z}说可以|问一下{Z}|房东叫{Z}|他叫{Z}|签收人{Z}，|
{Y}先生来电|{Y}女士同意了|请{Y}先生回电|已通知{Y}女士|{Y}先生和{Y}女士都在|尊敬的{Y}先生：|
邮箱：{E}|邮箱是{E}|请发到{E}|邮件{E}没收到|联系邮箱{E}|写信给{E}即可|抄送{E}|
电话：{P}|电话{P}|手机{P}|手机号：{P}|请拨打{P}|我的号码是{P}|联系电话{P}|打{P}找我|微信和手机都是{P}|传真{P}|座机{P}，上午在|微信{P}|微信号{P}，晚上回|夜间值班{P}|加我{P}|热线{P}|语音{P}|有事拨{P}|
身份证号：{I}|身份证{I}|身份证号码是{I}|证件号{I}|护照号{I}|护照：{I}|社保号{I}|税号{I}|登记的证件是{I}|实名{I}|实名认证用{I}|他的证件是{I}|复印件上是{I}，别外传|身份证尾号前是{I}|证件：{I}|
地址：{C}|办公室在{C}|搬去{C}|包裹放{C}门口|仓库设在{C}|新家在{C}|地址是{C}|寄到{C}|住在{C}|搬到{C}了|快递送{C}3楼|公司在{C}二单元|收货地址{C}，{Z}收|约在{C}门口|{C}的房子|家住{C}|住址：{C}|送到{C}，到付|门店开在{C}|
{D}已关闭|{H}没有权限|{X}{D}|占用{D}|{D}超时|见{D}|{X}又崩了|{X}平台上线|重启{X}|已处理{D}|{X}项目延期"""
PHRASES = {"en": ENGLISH, "de": GERMAN_PHRASES, "zh": CHINESE_PHRASES}
KIND = {"N": NAME, "T": NAME, "Z": NAME, "Y": NAME, "E": EMAIL, "P": PHONE, "I": ID, "A": ADDRESS, "C": ADDRESS}


def phrases(language: str) -> list[str]:
    return [p for p in PHRASES[language].replace("\n", "").split("|") if p]


def wide(text: str) -> str:
    """Digits and signs in their full-width forms."""
    return "".join(chr(ord(c) + 0xFEE0) if c in "0123456789+-()@." else c for c in text)


class Texts:
    """Endless labelled texts: (text, spans)."""

    def __init__(self, parts: list[tuple[str, str]], background: list[str], seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.maker, self.background = Maker(parts, self.rng), background
        self.by_language = {k: phrases(k) for k in PHRASES}

    def phrase(self) -> tuple[str, list[tuple[int, int, int]]]:
        m = self.maker
        language = m.pick(["en", "en", "en", "de", "zh", "zh"])
        return self.fill(m.pick(self.by_language[language]), language)

    def fill(self, form: str, language: str) -> tuple[str, list[tuple[int, int, int]]]:
        m, out, spans = self.maker, "", []
        turn = language == "zh" and m.chance(0.15)
        for k, piece in enumerate(form.replace("{", "}").split("}")):
            if k % 2 == 0:
                out += piece
                continue
            value = {
                "N": lambda: m.han_name() if m.chance(0.04) else m.name(), "T": lambda: m.surname() if m.chance(0.8) else m.name(), "Z": lambda: m.name() if m.chance(0.1) else m.han_name(), "Y": lambda: m.han_name(True), "E": m.email, "P": m.phone,
                "I": m.identity, "A": m.address, "C": m.han_address, "G": m.first, "H": m.handle, "X": m.product, "D": m.decoy,
            }[piece]()
            if turn and piece in "PIEC":
                value = wide(value)
            elif language == "zh" and piece in "PIE" and m.chance(0.3):
                value = value if not out or out[-1] in "：: " else value
            if piece in KIND:
                at = len(out)
                spans.append((at, at + len(value), KIND[piece]))
            out += value
        if language != "zh" and m.chance(0.15):
            out = out[0].upper() + out[1:] if not spans or spans[0][0] > 0 else out
        return out, spans

    def text(self) -> tuple[str, list[tuple[int, int, int]]]:
        m, out, spans = self.maker, "", []
        pieces = [self.background[int(self.rng.integers(len(self.background)))] if m.chance(0.5) else None for _ in range(int(self.rng.integers(1, 4)))]
        pieces.insert(int(self.rng.integers(len(pieces) + 1)), None)
        for b in pieces:
            if out:
                out += m.pick([" ", " ", " ", ". ", "\n", "\\n", "。", "，", " / ", "; "]) if out[-1] not in " \n" else ""
            if b is not None:
                out += b + (m.pick([" ", ". ", "; ", "，", " ("]) + m.decoy() if m.chance(0.3) else "")
                continue
            p, s = self.phrase()
            spans += [(a + len(out), e + len(out), k) for a, e, k in s]
            out += p + m.pick([".", "", "", "。", "!", ",", ", ok?", " (see notes)", "；", " then", "，谢谢", " - urgent", ")", "|"])
        return out, spans
