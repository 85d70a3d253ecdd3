"""Trains the conditional random field of `pii`: python -m quarryline.llm.train_pii OUT LOCALES [SENTENCES].

The labelled sentences are generated: common and invented names, addresses and numbers in the public formats of several
countries, set into sentences of mails, letters, notes, shell calls and records in several languages, and phrases that
look like names or numbers and aren't. Ordinary text without personal data comes from Python's own documentation and from
the message catalogues of public programs (LOCALES, a folder of gettext catalogues); its words make the list of common
words. No table of this project is read, and the sentences here are not those of its tables.

The weights maximise the conditional log likelihood of the labelled sentences (gradients by forward and backward sums,
AdaGrad, a quadratic penalty).
"""

from __future__ import annotations

import gettext
import glob
import gzip
import json
import random
import re
import sys
from collections import Counter, defaultdict

from quarryline.llm import pii

GIVEN = """James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles
Karen Daniel Nancy Matthew Lisa Anthony Betty Steven Margaret Paul Sandra Andrew Emily Donna Kevin Michelle Brian Carol George Amanda
Edward Melissa Timothy Deborah Laura Anna Maria Sofia Lucía Carmen José Javier Pablo Diego Andrés Juana Teresa Pilar Raúl Beatriz Hans
Klaus Jürgen Günther Ursula Monika Heike Sabine Stefan Andreas Matthias Björn Lars Sven Ingrid Astrid Pierre Jean Luc François Chloé Camille
Hélène Thérèse Mathieu Antoine Giulia Marco Paolo Francesca Luigi Chiara João Mariana Tiago Beatriz Piotr Agnieszka Krzysztof Małgorzata Łukasz
Katarzyna Olga Dmitri Sergei Natasha Ivan Svetlana Yuki Hiroshi Wei Ling Ahmed Fatima Hassan Aisha Rajesh Sunita Deepak Anjali Kwame Amara Chidi
Ngozi Mehmet Elif Siobhán Niamh Seán Owen Rhys June April Faith Hope Dawn Ivy Daisy Violet Frank Jack Rob Pat Art Victor""".split()
SURNAMES = """Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor
Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Green Adams Nelson Baker
Hall Rivera Campbell Mitchell Carter Roberts Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein
Wolf Schröder Neumann Zimmermann Dubois Moreau Laurent Lefebvre Leroy Roux Fournier Girard Bonnet Lambert Fernández Sánchez Pérez Gómez Ruiz
Jiménez Álvarez Romero Navarro Domínguez Rossi Ferrari Esposito Bianchi Romano Ricci Marino Silva Santos Ferreira Pereira Oliveira Nowak Kowalski
Wiśniewski Wójcik Kamiński Lewandowski Zieliński Ivanov Petrov Smirnov Kuznetsov Popov Andersson Johansson Karlsson Nilsson Eriksson Larsen Olsen
Hansen Jensen de-Vries Jansen Bakker Visser Yılmaz Kaya Demir Tanaka Suzuki Watanabe Chen Wang Zhang Singh Patel Sharma Okafor Mensah O'Brien
O'Neill McCarthy MacDonald Fitzgerald Murphy""".split()
CYRILLIC_GIVEN = "Иван Мария Алексей Елена Дмитрий Ольга Сергей Наталья Андрей Татьяна Павел Юлия Николай Анна Виктор Ирина Михаил Галина".split()
CYRILLIC_SURNAMES = "Иванов Петрова Смирнов Кузнецова Попов Соколова Лебедев Козлова Новиков Морозова Волков Павлова Шевченко Коваленко Бондаренко Ткаченко".split()
PARTICLES = "de van von del da di la du dos".split() + ["de la", "van der", "van den", "von der", "de los"]
ONSETS = "b br c ch cr d dr f fl g gr h j k kl l m n p pr qu r s sh st t th tr v w y z".split()
VOWELS = "a e i o u ai ea ie oo ou á é í ö ü".split()
CODAS = ["", "", "", "l", "m", "n", "nd", "r", "rd", "s", "sk", "t", "th", "x", "ng", "ck"]
ENDINGS = "son sen ton ham ford wood man mann ski ska ov ova ev escu ez es is ini etti eau ard ier well worth ley berg stein feld bach dal strand qvist ström gren off enko yan oğlu".split()
STREET_NAMES = "Maple Cedar Birchwood Lincoln Washington Jefferson Highland Sunset Riverside Meadow Chestnut Victoria Albert Queen's King's Station Church Spring Valley Lakeview Magnolia".split()
KINDS = "Street St St. Road Rd Avenue Ave Ave. Boulevard Blvd Lane Ln Drive Dr Court Ct Place Square Terrace Way Close Crescent Gardens Row Hill Parkway".split()
FRENCH = ["rue {}", "rue de {}", "rue de la {}", "avenue {}", "avenue du {}", "boulevard {}", "place {}", "chemin du {}", "allée des {}", "quai {}", "impasse {}", "rue des {}", "passage {}"]
FRENCH_NAMES = "République Liberté Gare Église Lilas Victor-Hugo Pasteur Gambetta Fontaine Château Peupliers Moulins Clemenceau Voltaire Marronniers Halles Vieux-Port".split()
SOUTHERN = ["Calle {}", "Calle de {}", "C/ {}", "Avenida {}", "Avda. de la {}", "Plaza {}", "Paseo de {}", "Camino de {}", "Rua {}", "Via {}", "Viale {}", "Piazza {}", "Corso {}", "Ronda {}", "Calle del {}", "ul. {}", "Calle de los {}"]
SOUTHERN_NAMES = "Alcalá Serrano Colón Libertad Rosales Sol Goya Cervantes Garibaldi Roma Dante Mazzini Flores Augusta Constitución Marszałkowska Długa Pinos Río".split()
GERMAN_STEMS = "Haupt Bahnhof Schiller Goethe Kirch Schul Berg Wald Wiesen Eichen Birken Markt Brunnen Garten Mozart Beethoven Rathaus Sonnen Feld".split()
GERMAN_ENDS = "straße strasse str. weg gasse allee platz ring damm ufer straat laan gracht vägen".split()
GERMAN_WHOLE = ["Am Markt", "Im Winkel", "An der Kirche", "Zum Bahnhof", "Auf der Höhe", "Unter den Eichen", "Am Stadtpark", "In der Aue", "Zur Linde"]
TOWNS = "Springfield Riverton Fairview Greenville Bristol Leeds York Berlin Hamburg München Köln Paris Lyon Lille Nantes Madrid Sevilla Valencia Bilbao Roma Milano Torino Lisboa Porto Utrecht Leiden Kraków Gdańsk Lund Malmö".split() + ["New Haven", "Santa Clara", "Le Mans", "Bad Homburg", "San Marino", "Fort Wayne", "Saint-Malo", "Castrop-Rauxel"]
HOSTS = "gmail.com outlook.com yahoo.co.uk web.de gmx.net orange.fr libero.it proton.me uni-bonn.de state.edu acme.io company.org mail.ru wp.pl firm.co.jp dept.school.ac.uk".split() + ["sales.firm.example", "home.invalid", "xn--bcher-kva.example", "office.localdomain"]
TOPICS = "parser router scheduler cache index buffer panel toolbar pipeline worker queue socket snapshot branch release cluster module kernel lexer registry".split()
TOOLS = "git npm cargo docker kubectl make pip yarn terraform ansible systemctl apt brew gradle".split()
VERBS = "build status test install lint deploy restart update clean fetch push pull format".split()
PRODUCTS = "Python Rust Java Kotlin Swift Ruby Perl Haskell Scala Docker Kubernetes Postgres Redis Kafka Spark Hadoop Bazel Gradle Maven Linux Debian Ubuntu Windows Chrome Firefox Safari Vim Emacs GitHub Jenkins Terraform Nginx Django Rails React Angular Elixir Fortran Julia Ada Delphi Oracle Android Travis Puppet Jupyter Flask".split()
NOUNS = "period theme case effect number point table curve diagram map theory method test format code protocol machine update view page state rule field chart matrix process model window series line coding box plot clause list form set loop graph product event block ring key path law scale track draft edition setup hack spec bug patch flag hint tag bar".split()
FILES = "main.rs app.py index.ts README.md Makefile setup.cfg server.go lib/util.rb docs/guide.md config.yaml".split()

r = random.Random(29)
pick = r.choice


def digits(mask: str) -> str:
    """The mask with 0 as any digit, x as any hexadecimal digit, A as any capital."""
    return "".join(str(r.randint(0, 9)) if c == "0" else r.choice("0123456789abcdef") if c == "x" else r.choice("ABCDEFGHJKLMNPRSTWXYZ") if c == "A" else c for c in mask)


def invented(ending: bool) -> str:
    word = "".join(pick(ONSETS) + pick(VOWELS) + (pick(CODAS) if r.random() < 0.6 else "") for _ in range(r.choice([1, 2, 2, 2, 3])))
    return (word + (pick(ENDINGS) if ending and r.random() < 0.7 else "")).capitalize()


def given() -> str:
    return pick(GIVEN) if r.random() < 0.4 else invented(False)


def surname() -> str:
    one = pick(SURNAMES) if r.random() < 0.4 else invented(True)
    return f"{one}-{pick(SURNAMES) if r.random() < 0.5 else invented(True)}" if r.random() < 0.1 else one


def name(whole: bool = False) -> str:
    x, g, s = r.random(), given(), surname()
    gap = "\xa0" if r.random() < 0.07 else " "
    if x < 0.52:
        n = f"{g}{gap}{s}"
    elif x < 0.61:
        n = f"{s}, {g}"
    elif x < 0.67:
        n = f"{g} {r.choice('ABCDEFGHIJKLMNOPRSTVW')}. {s}"
    elif x < 0.74:
        n = f"{g}{gap}{pick(PARTICLES)} {s}"
    elif x < 0.77:
        n = f"{pick(PARTICLES)} {s}, {g}"
    elif x < 0.79:
        n = f"{g} {given()} {s}"
    elif x < 0.82 and not whole:
        n = f"{g} {s[0]}."
    elif x < 0.85 and not whole:
        n = f"{g[0]}. {s}"
    elif x < 0.94 and not whole:
        n = g
    else:
        n = f"{pick(CYRILLIC_GIVEN)} {pick(CYRILLIC_SURNAMES)}"
    y = r.random()
    return n.upper() if y < 0.07 else n.lower() if y < 0.15 and " " in n and "." not in n else n


def email() -> str:
    g, s = given().lower(), surname().lower().replace("'", "")
    local = pick([f"{g}.{s}", f"{s}.{g}", f"{g}_{s}", f"{g}-{s}", f"{g[0]}{s}", f"{s}{g[0]}", f"{g}{r.randint(1, 1999)}", f"{g}.{s}+{pick(TOPICS)}", f"{s}.{g[0]}", "info", "support", f"{g}.{s}.work"])
    host, x = pick(HOSTS), r.random()
    e = (
        f"{local}@{host}" if x < 0.74
        else f"{local} (at) {host.replace('.', ' (dot) ')}" if x < 0.8
        else f"{local} AT {host.replace('.', ' DOT ')}" if x < 0.86
        else f"{local} [at] {host}" if x < 0.91
        else f"{local}[at]{host.replace('.', '[dot]')}" if x < 0.95
        else f"{local}＠{host}"
    )
    return e.upper() if r.random() < 0.05 else e


#: Public number plans: North America, then other countries' international and national forms (fixed values).
PHONES = """(000) 000-0000|000-000-0000|000.000.0000|+1 000 000 0000|+1-000-000-0000|+1 (000) 000-0000|1-000-000-0000|+10000000000|0010000000000|+44 0000 000000|+44 00 0000 0000|07000 000000|020 0000 0000
|+49 000 0000000|+49 00 00000 000|0000/0000000|030 0000000|0000/00000-00|0000 0000000|+33 0 00 00 00 00|00 00 00 00 00|+34 000 00 00 00|+34 000 000 000|+39 000 000 0000|+351 000 000 000|+48 000 000 000
|+7 (000) 000-00-00|+7 000 000-00-00|+31 0 00000000|+31 00 000 0000|+46 00 000 00 00|+61 000 000 000|+81 00-0000-0000|+91 00000 00000|+55 00 00000-0000|+380 00 000 0000""".replace("\n", "").split("|")
#: Labels and forms of identity numbers as their issuers publish them (fixed values).
IDENTITIES = """SSN:000-00-0000|SSN:000 00 0000|SSN:000000000|Social Security No.:000-00-0000|Social Security no:000 00 0000|ssn:000-00-0000|ssn:000000000|passport:AA0000000|passport:A00000000|passport number:AA0000000|passport number:000000000
|Passport No:AA0000000|Reisepass:A00000000|passeport:00AA00000|pasaporte:AAA000000|DNI:00000000A|DNI:00000000-A|DNI:00.000.000-A|documento:00000000A|NIE:A0000000A|NIF:00000000A|Steuer-ID:00000000000|Steuer-ID:00 000 000 000|Steuernummer:00/000/00000
|Personalausweis:A00000000|National Insurance:AA 00 00 00 A|NI no.:AA000000A|NINO:AA 00 00 00 A|NINO:AA000000A|driving licence:AAAAA000000AA0AA|driver licence:A0000000|driver's license number:A000-0000-0000|driver license:A000-0000-0000
|national id:000000-0000|personnummer:000000-0000|BSN:000000000|PESEL:00000000000|CPF:000.000.000-00|SIN:000-000-000|EIN:00-0000000|Tax ID:00-0000000|TFN:000 000 000|codice fiscale:AAAAAA00A00A000A|NIR:0 00 00 00 000 000 00|ID card:AA000000
|identity card:000000000|паспорт:0000 000000|ИНН:000000000000|СНИЛС:000-000-000 00|id number:00000000A|identity number:AA0000000|id:000-00-0000|id:AA0000000|id:00000000A|id:000 00 0000""".replace("\n", "").split("|")


def phone() -> str:
    return digits(pick(PHONES))


def identity() -> tuple[str, str]:
    label, mask = pick(IDENTITIES).split(":")
    return label + pick([" ", " ", ": ", " = ", "=", " is ", " no. "]), digits(mask)


def address() -> str:
    n, x = str(r.choice([r.randint(1, 40), r.randint(1, 400), r.randint(100, 9999)])), r.random()
    unit = ""
    town = pick(TOWNS) if r.random() < 0.6 else invented(True)
    if r.random() < 0.1:
        town = f"{pick(['Port', 'North', 'East', 'Bad', 'Saint', 'Lower'])} {invented(False)}"
    if x < 0.5:
        street = pick(STREET_NAMES) if r.random() < 0.4 else invented(True) if r.random() < 0.7 else pick(["St. ", "Old ", "West ", "Upper "]) + invented(True)
        a = f"{n}{'AB'[r.randint(0, 1)] if r.random() < 0.15 else ''} {street} {pick(KINDS)}"
        unit = pick([f", Apt {r.randint(1, 60)}", f" Apt {r.randint(1, 60)}{pick('ABCD')}", f", Unit {r.randint(1, 30)}", f" Unit {r.randint(1, 30)}", f", Flat {r.randint(1, 30)}", f", Suite {r.randint(1, 400)}", f" #{r.randint(1, 90)}"])
    elif x < 0.66:
        a = f"{n}{pick([' bis', ' ter']) if r.random() < 0.15 else ''}{pick([', ', ' '])}{pick(FRENCH).format(pick(FRENCH_NAMES) if r.random() < 0.6 else invented(False))}"
    elif x < 0.83:
        a = f"{pick(SOUTHERN).format(pick(SOUTHERN_NAMES) if r.random() < 0.6 else invented(False))}{pick([' ', ', ', ' '])}{n}"
        unit = pick([f", {r.randint(1, 9)}º {pick('ABCD')}", ", bajo", f", {r.randint(1, 9)}º"])
    else:
        a = f"{(pick(GERMAN_STEMS) if r.random() < 0.6 else invented(False)) + pick(GERMAN_ENDS) if r.random() < 0.75 else pick(GERMAN_WHOLE)} {n}{r.choice('abc') if r.random() < 0.1 else ''}"
    if unit and r.random() < 0.3:
        a += unit
    y = r.random()
    if y < 0.25:
        return f"{a}, {digits('00000')} {town}"
    return f"{a}, {town}" if y < 0.42 else f"{a}, {town}, {digits('AA 00000')}" if y < 0.47 and x < 0.5 else a


def address_of_host() -> str:
    return ".".join(str(r.choice([r.randint(0, 255), r.randint(100, 255), r.randint(0, 99)])) for _ in range(4))


def phrase() -> str:
    """A noun phrase of technical text that isn't personal, often much like what is."""
    w, cap = pick(TOPICS), (pick(GIVEN) if r.random() < 0.5 else invented(False))
    one = [
        lambda: f"the {w}", lambda: f"{pick(TOPICS)} {w}", lambda: f"`{w}_{pick(TOPICS)}`", lambda: f"`{w.title()}{pick(TOPICS).title()}`", lambda: f"`{cap}{w.title()}`", lambda: f"{cap}{invented(True)}{pick(['Exception', 'Handler', 'Test'])}",
        lambda: f"the {cap} {w}", lambda: f"{cap} {pick(['theorem', 'filter', 'mode', 'layout', 'style', 'notation', 'sort', 'tree', 'palette', 'phase'])}", lambda: f"{cap} {pick(NOUNS)}", lambda: f"{cap} {pick(NOUNS)}", lambda: f"the {cap} {pick(NOUNS)}", lambda: f"{cap}-{pick(NOUNS)} {pick(NOUNS)}s", lambda: pick(PRODUCTS), lambda: f"{pick(PRODUCTS)} and {pick(PRODUCTS)}", lambda: f"{pick(PRODUCTS)}, {pick(PRODUCTS)} and {pick(PRODUCTS)}", lambda: f"{pick(PRODUCTS)} {pick(NOUNS)}s", lambda: f"{cap}-{pick(['style', 'based', 'like', 'type'])} {w}s", lambda: f"the {cap} {pick(['project', 'compiler', 'library', 'dialect', 'release', 'sprint'])}",
        lambda: f"{pick(['Court', 'Street', 'Road', 'Lane', 'Park', 'Square', 'Place', 'Drive', 'Hill'])} {pick(['mode', 'layer', 'widget', 'names', str(r.randint(1, 30)), 'Editor'])}", lambda: f"{pick(['Street', 'Avenue', 'Lane', 'Route'])} {r.randint(1, 40)}", lambda: f"{pick(KINDS)[:6]}.{pick(['tsx', 'py', 'css'])}",
        lambda: f"{r.randint(2, 990)} {invented(False)} {pick(['shards', 'nodes', 'files', 'rows', 'events'])}", lambda: digits(pick(["000 000 entries", "0 000 000 requests", "00 000 lines"])),
        lambda: f"{pick(NOUNS + TOPICS)} {digits(pick(NUMBERS))}", lambda: f"{pick(['id', 'session', 'build', 'ticket', 'rev', 'port', 'epoch', 'trace', 'PR', 'hash', 'record', 'key'])} {digits(pick(NUMBERS))}", lambda: f"{digits(pick(NUMBERS))}{pick([' ms', ' bytes', ' rows', ' us', ' kB', ' times'])}",
        lambda: pick(["job ", "order ", "run ", "case ", "item ", "node ", "request ", "block ", "chunk ", "event ", "slot ", "span ", "shard ", "message ", "invoice ", "id ", "index ", "offset ", "counter ", "serial "])
        + digits(pick(["000-0000-0", "00000-00000", "0000-00-0000", "000-000-0000", "000000000", "0000000000", "00-0000-00", "AA-0000", "AAA-0000-00", "00000", "000 000", "0000000000000000", "000-00-00000"])),
        lambda: digits(pick(["000-000-0000 ms", "0000000000 bytes", "000 000 0000 ns", "(000) 000..0000", "000-0000 kB", "000000000 ticks", "0000000-0000000", "1600000000", "1700000000000"])),
        lambda: digits(pick(["xxxxxxx", "0xxxxxxxxx", "xxxxxxxx-xxxx-4xxx-8xxx-xxxxxxxxxxxx", "sha256:xxxxxxxxxxxxxxxxxxxx", "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx"])), lambda: digits(pick(["127.0.0.1:0000", "fe80::xxxx:xxxx", "0.00.0", "v0.0.00", "00.0.0-rc0", "00.00.0000", "0000x0000", "0.000.0"])),
        lambda: digits(pick(["2025-10-00 00:00:00", "2024-00-00T00:00:00Z", "00:00:00.000", "00/00/2023", "00 Jan 2020"])), address_of_host, address_of_host, lambda: f"{pick(TOOLS)} {pick(VERBS)}", lambda: f"`{pick(TOOLS)} {pick(VERBS)}`", lambda: f"{pick(TOOLS)} {pick(VERBS)} --{pick(VERBS)}",
        lambda: f"{pick(TOOLS)}@{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 9)}", lambda: f"git@github.com:{w}/{pick(TOPICS)}.git", lambda: f"root@{w}-{r.randint(1, 40)}:~#", lambda: f"{w}@host{r.randint(1, 300)}:/srv$", lambda: f"deploy@10.0.{r.randint(0, 99)}.{r.randint(0, 99)}", lambda: f"HEAD@{{{r.randint(0, 90)}}}", lambda: f"postgres://{w}@db.internal:5432/{pick(TOPICS)}", lambda: f"ssh://{w}@gerrit.local:{digits('00000')}/{pick(TOPICS)}",
        lambda: f"@{w}", lambda: f"@{w}_{pick(VERBS)}", lambda: "@dataclass", lambda: f"/usr/local/{w}", lambda: f"/home/{cap.lower()}/{w}", lambda: f"C:\\Users\\{cap}\\{w}", lambda: f"src/{w}/{pick(FILES)}:{r.randint(1, 900)}", lambda: pick(FILES), lambda: f"{w}::{pick(VERBS)}()", lambda: f"https://example.org/{w}/{r.randint(1, 99999)}",
        lambda: f"{w}-{cap.lower()}", lambda: f"{cap.upper()}_{w.upper()}", lambda: pick(["Visual Studio", "Stack Overflow", "Google Drive", "Red Hat", "Apple Silicon", "Open Source", "Pull Request", "Code Review", "Getting Started", "Release Notes", "New York", "Hong Kong", "Access Denied", "Exit Code", "Merge Conflict", "Best Regards", "Quick Start", "Thank You"]),
        lambda: f"the {pick(['March', 'April', 'June', 'Monday', 'Friday', 'August'])} {pick(['milestone', 'outage', 'meeting', 'branch', 'report'])}",
    ]
    return pick(one)()


#: Forms of numbers that mean nothing personal.
NUMBERS = "000-0000-0|00000-00000|0000-00-0000|000000000|0000000000|00-0000-00|AA-0000|AAA-0000-00|00000|000 000|0000000000000000|0000|000000|0000-000-00|00-00-00|0.00.000|00.0.000|0.000.00|0000.00|00000000|000-0000-00|0000 0000|00000000000".split("|")
#: Words for slots: V what persons do, W what one does to persons, Q and B what joins a name to the rest.
VERBAL = {
    "V": "said asked told wrote thinks wants needs knows found fixed tried broke owns likes prefers joined left called answered agreed refused noticed reported suggested believes claims insists hopes forgot remembered signed paid moved lives works sent brought read saw heard mentioned explained confirmed denied started finished leads manages teaches hates uses has had was is will can could went got gave made took came met".split(),
    "W": "call ask tell email meet thank invite remind thank warn help join follow visit phone text contact pay hire introduce consult notify inform congratulate interview replace trust Call Ask Tell Email Meet Thank Invite Remind Warn Help Join Visit Phone Contact Pay Notify Inform Introduce Consult Let".split(),
    "Q": "about before after whether if when because and or so that while at on in for with regarding unless until once since then today tomorrow again".split(),
    "B": "by from for to with and or of after before behind about without near via between like than as were are was was is by from to with present including except besides".split(),
}
#: Sentences with slots: N name, E mail address, P phone, A street address, I label and identity number, X a technical phrase.
WITH = """{N} {V} {X}.|{N} {V} {X}|{N} {V} that {X} is slow.|{N} {V} it.|and {N} {V} {X}.|{N} and {N} {V} {X}.|my {W} {N}|{W} {N} {Q} {X}.|{W} {N} {Q} the meeting.|please {W} {N} {Q} {X}|{W} {N} and {N} {Q} lunch.|{W} {N}|{W} {N}.|{X} {B} {N}|{X} {B} {N}.|{X} {B} {N} {Q} {X}.|it {V} {B} {N}, {X}|{X} {B} {N}, {N} and {N}.|"{W} {N} {Q} {X}," he said.|a letter {B} {N} {V} here.|{Q} {N} {V} {X}, {W} {N}.|our neighbour {N} {V} {X}|her boss {N}|The lawyer, {N}, {V} nothing.|unser Chef {N} {V} {X}|notre voisin {N} {V} {X}|mi jefe {N} {V} {X}|наш коллега {N} {V} {X}|Kind regards, {N}|Best wishes,  {N}|Many thanks to {N} for the report on {X}.|Please contact {N} at {P} or {E}.|{N} <{E}>|Reported-by: {N} <{E}>|Acked-by: {N} <{E}>|From: {N} <{E}>|To: {N} <{E}>; {N} <{E}>|Attendees: {N}, {N} and {N}
|{N} will be away until Monday; call {P} instead.|Yesterday {N} told me that {X} is slow.|I spoke to {N} about {X}.|This was approved by {N}.|Approved by Dr. {N} and Prof. {N}|checked by Ms. {N}, see {X}|We hired {N} to run {X}.|According to {N}, {X} broke first.|{N} asked us whether {X} works.|{N} replied: "looks fine"|{N} wrote back that {X} is done.
|{N} says hello.|{N} thinks {X} is to blame.|{N} is the owner of {X}.|{N} and {N} fixed {X} together.|My colleague {N} owns {X}.|Talk to {N} first.|Could you ask {N} to restart {X}?|Good morning {N}, could you look at {X}?|Hello {N},|Dear {N},|Dear Mr {N}, thank you for your letter.|Hey {N}! {X} is back.|guest list: {N}, {A}, {P}|{A}, {P}|Visit {N}, {A}, {P}, any day.|{N} {P}|{N}, {P}|rent paid for {A}, {P}|tester {N}|signatory {N}|driver {N}, {A}|member {N} resigned|speaker {N}|teacher {N}|new client {N}|The last entry lists {N}, {I}.|The table keeps {N}, {P}, for now.|{"note":"{N} wants {X}"}|{"text":"{N} uses {E}"}|log {"event":"saved","by":"{N}"}|save {"fact":"{N} works on {X}"}|'{P}' became '{P}'|was '{P}', now '{P}'|from '{P}' to '{P}'|no longer {P} but {P}|seen by Dr. {N}|signed by Mr. {N} after {X}|none but {N} had tried {X}|{A} or {P}|Both {A} and {P} are fake.|Hi {N}, how is {X}?|Hi {N}, {X}|Hi {N}!|{N} has {X}|{N} had a question on {X}.|{N} likes {E} best|write {E}: {X}|report by {E}: {X}|tell {N}.|please tell {N} and {N}|pour {N}.|für {N} an {E}|paid by {N}, {I}|kept {N}, {I}|{P}|{P}|{A}|{N}|{E}|{N} / {A} / {P}|{P} / {E} / {I}|file of {N} / {P}|cc: {N}|assignee: {N}|author: {N}|owner = {N}|name: {N}|Name: {N}, phone: {P}, address: {A}
|customer_name="{N}"|{"name": "{N}", "email": "{E}"}|{"customer":{"fullName":"{N}","tel":"{P}","street":"{A}"}}|curl -d 'user={N}&mail={E}' http://localhost:8080/users|INSERT INTO customers (name, phone) VALUES ('{N}', '{P}');|UPDATE staff SET address = '{A}' WHERE name = '{N}';|SELECT * FROM people WHERE email = '{E}'|git commit --author="{N} <{E}>" -m "fix {X}"|git log --author='{N}'|mail -s "{X}" {E}|echo "{E}" >> list.txt
|{N};{E};{P}|{N},{P},{A}|{N}\t{E}\t{P}|<person>{N}</person><tel>{P}</tel>|- {N} ({P})|* {N}: {E}|1. {N}, {A}|user {N} logged out|patient {N}, born 1970|candidate {N} passed|witness: {N}|the tenant {N} moved to {A}|Send the parcel to {N}, {A}.|Deliver to {A} by Friday.|The office is at {A}.|Our new address: {A}.|She lives at {A}.|He moved from {A} to {A}.|Meet me at {A} at noon.|Billing address {A}|ship_to: "{A}"|pick it up from {A}, then call {P}
|You can reach me on {P}.|Phone {P}|Tel: {P}|mobile {P}|Fax {P}, mail {E}|Call {P} for {X}.|Her number is {P}.|his number was {P}, try {X}|the number is {P} and the mail {E}|use number {P} after {X}|dial {P} and ask for {N}|sms to {P} failed|The number {P} is stored in {X}.|grep '{P}' {X}|replace '{P}' by '{P}'|search for "{P}"|contact={P}|Write to {E} about {X}.|Mail {E} if {X} fails.|bounced: {E}|login {E} rejected|{E} reported {X}|{E}, {E}|http://example.com/subscribe?email={E}|the account {E} is locked|notify="{E}"|remind {N} that {X} needs {E}
|My {I}.|Her {I} leaked in {X}.|{I}|{I}, {N}|employee {N}, {I}|The form asks for {I}.|my {I}, please delete it from {X}|remove {I} from the fixture|"{I}"|{N} / {I} / {P}|fill #name "{N}" #phone "{P}"|type #ssn "{J}" into the form|set #id "{J}" and #street "{A}"|<input id="passport" value="{J}">|Fill in "{A}" and "{P}" there.|remember that {N} likes tea|note: call {N} {P}|remind me to phone {N} about {X}|task add "visit {N}, {A}"|message to {N}: {X} is finished|{N} joined at 10:00.|{N}: yes|{N}, can you check {X}?|only {N} has read {X}|with {N} in the room, {N} said no|on {X} by {N}.
|Sehr geehrte Frau {N}, vielen Dank.|Sehr geehrter Herr {N},|Hallo {N}, {X} ist fertig.|Viele Grüße, {N}|Ansprechpartner: {N}, {P}|Bitte {N} unter {P} anrufen.|Fragen bitte an {N} oder {E}.|Die Anschrift lautet {A}.|Ich wohne in der {A}.|Wir liefern an {A}.|Telefon {P}, E-Mail {E}|Meine {I}.|Der Vertrag von {N} liegt in {X}.|Das Konto für {N} wurde gesperrt.|{N} hat {X} geprüft.|Frau {N} kommt morgen.
|Bonjour {N}, {X} est prêt.|Cordialement, {N}|Contactez {N} au {P}.|Merci d'envoyer le colis au {A}.|Mon adresse : {A}|Appelez le {P} ou écrivez à {E}.|Mme {N} a signé.|M. {N} habite {A}.|Le dossier de {N} est dans {X}.|{N} a demandé {X}.|Mon {I}.
|Hola {N}, gracias por {X}.|Un saludo, {N}|Llame a {N} al {P}.|Mi dirección es {A}.|Vivo en {A}.|Mi correo es {E} y mi teléfono {P}.|El señor {N} firmó.|Lo revisó {N}.|Según {N}, {X} falla.|Mi {I}.|mi documento es {J}|La cuenta de {N} usa {E}.|Olá {N}, tudo bem?|Moro na {A}.|Ciao {N}, ti chiamo al {P}.|Abito in {A}.|Il signor {N} ha chiamato.|Cześć {N}, zadzwoń: {P}|Pani {N} mieszka: {A}.
|Здравствуйте, {N}!|Звоните {N}: {P}|Мой адрес: {A}, телефон {P}.|С уважением, {N}|Ответственный: {N}, {E}|Письмо от {N} пришло.|Смотрел {N}.|Мой {I}.""".replace("\n", "").split("|")
#: Sentences without personal data, X as above.
WITHOUT = """{X} {V} {X}.|{X} {V} it.|{W} {X} {Q} {X}.|{X} {B} {X}.|{Q} {X} {V} {X}, {W} {X}.|{W} it {Q} {X}|{Q} {X} {V} {X}|{X} and {X} {V} {X}.|Dear customer, {X} is out.|Dear team, {X} and {X}.|Hello everyone, {X}|Hi all, {X} is back|Hi there|Hi folks, see {X}|Liebes Team, {X}|Hola a todos, {X}|Restart {X} now.|Fix {X}|Refactor {X} and {X}.|Why is {X} so slow?|Is {X} safe?|Did {X} pass?|Will {X} be merged today?|May I delete {X}?|Please look at {X}.|Run {X} again.|{X} failed with {X}.|{X} is fine.|{X} was renamed.|Look into {X} before {X}.|Compare {X} with {X}.|{X}: {X}|- {X}|* see {X}|Deploy {X} to {X}.|Grant access to {X}.|Mark {X} as done.|Bill for {X} is paid.|Frank look at {X}|Rob the queue of {X}.|Check {X}, then {X}.|Tests for {X} are red.|The build of {X} took 40 s.|{X} handles {X} badly.|{X} and {X} use {X}.|Both {X} and {X} read {X}.|{X} hides {X}.|{X} needs {X} to compile.|Support {X} in {X}.|We port {X} to {X}.|Inspect {X} 2) run {X} 3) stop|1) open {X} 2) close {X}
|Added {X}.|Removed {X}, kept {X}.|Traced {X} down to {X}.|Nothing changed in {X}.|Warning: {X} is deprecated.|Error in {X}: not found|TODO: {X}|Opened {X}.|Closed {X} as a duplicate of {X}.|{"cmd":"{X}"}|{"dir":"{X}","mode":"r"}|{"action":"search","text":"{X}"}|{"before":"{X}","after":"{X}"}|shell {"run": "{X}"}|open {X}|cat {X}|ls {X}|sh -c '{X}'|exec "{X}"|query="{X}"|title: {X}|'{X}' is not a command|"{X}"|run("{X}")|{"tool": "{X}", "args": ["{X}"]}|curl https://api.example.net/{X}|yes|done|go on|name,phone,mail|Updated Notes For {X}|ticket {X}: {X}
|Bitte {X} prüfen.|Warum ist {X} so langsam?|Der Fehler in {X} ist behoben.|{X} läuft wieder.|Die Änderung an {X} ist klein.|Pourquoi {X} échoue ?|J'ai corrigé {X}.|La mise à jour de {X} est prête.|Revisa {X}, por favor.|Ya funciona {X}.|¿Por qué falla {X}?|Controlla {X}.|Sprawdź {X}.|Проверьте {X}.|Почему {X} не работает?|Исправил {X}.|Add A Heading To {X}|Keep {X} For Now|Turn {X} off.|Page {X} of the manual|Section 4.2 describes {X}.|Up 3.5% since {X}.|at {X} in {X}|from {X} to {X}|value {X}, was {X}|{X}, {X}, {X}""".replace("\n", "").split("|")


LANGUAGES = ("de", "fr", "es", "it", "pt", "pt_BR", "nl", "pl", "ru", "sv", "uk", "da", "cs", "ro", "tr")


def ordinary(locales: str, codes: tuple[str, ...] = LANGUAGES) -> list[str]:
    """Lines of Python's documentation and of the message catalogues found in the folder."""
    from pydoc_data import topics

    lines = [] if codes == ("de",) else [s for t in topics.topics.values() for s in re.split(r"(?<=[.:])\s+|\n\n", t)]
    for code in codes:
        for path in sorted(glob.glob(f"{locales}/{code}/LC_MESSAGES/*.mo")):
            if "iso_" in path:
                continue  # names of countries and languages
            try:
                with open(path, "rb") as f:
                    catalogue = gettext.GNUTranslations(f)._catalog
            except (OSError, UnicodeDecodeError, ValueError):
                continue
            lines += [s for k, t in catalogue.items() if k and isinstance(t, str) for s in t.split("\n")] + [k for k in catalogue if isinstance(k, str) and code == "de"]
    # No line of these texts may hold what it would teach to be plain text.
    clean = [" ".join(s.split()) for s in lines]
    return [s for s in clean if 8 < len(s) < 300 and "@" not in s and not re.search(r"\d{5}|copyright|written by|translat", s, re.I)]


def sentence(plain: list[str], with_data: list[str] = WITH, without: list[str] = WITHOUT) -> tuple[str, list[tuple[int, int, str]]]:
    text, gold = "", []
    for _ in range(r.choice([1, 1, 1, 2, 2, 3])):
        if text:
            text += " "
        x = r.random()
        if x < 0.18:
            text += pick(plain)
            continue
        frame = pick(with_data) if x < 0.62 else pick(without)
        if frame.startswith("{\"") and r.random() < 0.3:
            frame = pick(TOPICS) + " " + frame
        for part in re.split(r"(\{[NEPAIJXVWQB]\})", frame):
            kind = part[1] if len(part) == 3 and part[0] == "{" and part[2] == "}" else ""
            if kind in ("N", "E", "P", "A"):
                value = {"N": name, "E": email, "P": phone, "A": address}[kind]()
                gold.append((len(text), len(text) + len(value), {"N": "person_name", "E": "email", "P": "phone", "A": "street_address"}[kind]))
                text += value
            elif kind in ("I", "J"):
                label, value = identity()
                text += label if kind == "I" else ""
                gold.append((len(text), len(text) + len(value), "identity_number"))
                text += value
            elif kind in VERBAL:
                text += pick(VERBAL[kind])
            else:
                text += phrase() if kind == "X" else part
        if '{"' in frame and r.random() < 0.15:
            # Once more quoted: the places move by the strokes put before quotes.
            moved = [(a + text.count('"', 0, a), b + text.count('"', 0, b), k) for a, b, k in gold]
            text, gold = text.replace('"', '\\"'), moved
    return text, gold


def common_words(plain: list[str], german: list[str]) -> frozenset[str]:
    """Words written in lower case in ordinary text; of German text also the nouns, but no first word of a line."""
    counts = Counter(w for s in plain for w in pii.UNIT.findall(s) if not w[0].isupper())
    counts.update(w.lower() for s in german for w in pii.UNIT.findall(s)[1:] if len(w) > 3 and w[1:].islower())
    counts.update({w: 9 for s in WITH + WITHOUT for w in pii.UNIT.findall(re.sub(r"\{.\}", " ", s)) if not w[0].isupper()})
    counts.update({w: 9 for w in [*TOPICS, *TOOLS, *VERBS]})
    return frozenset(w for w, k in counts.items() if k >= 3 and len(w) > 1 and w.lower() == w)


def announcing_words(data: list[tuple[str, list]]) -> frozenset[str]:
    """Words that stand before names in a good part of their uses."""
    uses, before = Counter(), Counter()
    for text, gold in data:
        line = pii.Line(text)
        uses.update({w.lower() for _, _, w in line.tokens if w[0].isalpha()})
        before.update({line.before(a)[3] for a, _, k in gold if k == "person_name"})
    return frozenset(w for w, k in before.items() if k >= 20 and k > 0.4 * uses[w] and w != "^")


OWN_WORDS = ("p:w=", "p:first=", "p:last=")
CONTEXT = tuple(f"{t}:{k}" for t in "pes" for k in ("l1=", "l12=", "lw=", "r1=", "r12=", "lr=", "k|l1=", "k|lw=", "k|r1=", "n|r1=", "re="))


def train(n: int, plain: list[str], german: list[str], with_data: list[str] = WITH, without: list[str] = WITHOUT, epochs: int = 3, rate: float = 0.15, penalty: float = 1e-4, blind: float = 0.4) -> pii.Model:
    data = [sentence(plain, with_data, without) for _ in range(n)]
    words, announcing = common_words(plain, german), announcing_words(data)
    print(len(words), "common words;", len(announcing), "announcing:", " ".join(sorted(announcing)))
    prepared, missing = [], Counter()
    for text, gold in data:
        lattice = pii.Lattice(pii.Line(text), words, announcing)
        at = {s: k for k, s in enumerate(lattice.segments)}
        missing.update(g[2] for g in gold if g not in at)
        if lattice.segments:
            # Forgetting a name's words or the words around a segment now and then leaves the rest to decide.
            if r.random() < 0.5:
                lattice.features = [[f for f in fs if not f.startswith(OWN_WORDS)] for fs in lattice.features]
            if r.random() < blind:
                lattice.features = [[f for f in fs if not f.startswith(CONTEXT)] for fs in lattice.features]
            prepared.append((lattice, [at[g] for g in gold if g in at]))
    print("without candidate:", dict(missing), flush=True)
    w: dict[str, float] = defaultdict(float)
    seen: dict[str, float] = defaultdict(lambda: 1e-6)
    for epoch in range(epochs):
        r.shuffle(prepared)
        loss = 0.0
        for lattice, gold in prepared:
            score = [sum(w[f] for f in fs if f in w) for fs in lattice.features]
            step = [[sum(w[f] for f in fs if f in w) for _, fs in near] for near in lattice.near]
            ending, upto = pii.forward(lattice, score, step)
            of_segment, of_pair = pii.backward(lattice, score, step, ending, upto)
            slope: dict[str, float] = defaultdict(float)
            chosen = set(gold)
            for k, fs in enumerate(lattice.features):
                change = (k in chosen) - of_segment[k]
                if abs(change) > 1e-4:
                    for f in fs:
                        slope[f] += change
            total = upto[-1] - sum(score[k] for k in gold)
            for k, near in enumerate(lattice.near):
                for i, (j, fs) in enumerate(near):
                    # Gold neighbours are consecutive ones: none lies between two so near.
                    both = k in chosen and j in chosen and not any(j < m < k and m in chosen and lattice.segments[m][0] >= lattice.segments[j][1] for m in range(j + 1, k))
                    total -= both * step[k][i]
                    change = both - of_pair[k][i]
                    if abs(change) > 1e-4:
                        for f in fs:
                            slope[f] += change
            loss += total
            for f, g in slope.items():
                g -= penalty * w[f]
                seen[f] += g * g
                w[f] += rate * g / seen[f] ** 0.5
        print("epoch", epoch, "mean loss", round(loss / len(prepared), 4), flush=True)
    uses = Counter(f for lattice, _ in prepared for fs in lattice.features for f in set(fs))
    kept = {f: round(v, 2) for f, v in w.items() if abs(v) > 0.05 and (uses[f] > 2 or f.startswith("T:"))}
    return pii.Model(kept, words, announcing)


def evaluate(model: pii.Model, sentences: list[tuple[str, list]]) -> dict[str, tuple[float, float, int]]:
    """Of each type: precision, recall, mentions."""
    hit, said, true = Counter(), Counter(), Counter()
    for text, gold in sentences:
        guess = pii.decode(pii.Line(text), model)
        true.update(g[2] for g in gold)
        said.update(g[2] for g in guess)
        hit.update(g[2] for g in guess if g in gold)
    return {k: (hit[k] / max(1, said[k]), hit[k] / max(1, true[k]), true[k]) for k in pii.TYPES}


def show(title: str, figures: dict[str, tuple[float, float, int]]) -> None:
    for kind, (precision, recall, count) in figures.items():
        print(f"{title}, {kind}: precision {precision:.4f}, recall {recall:.4f}, {count} mentions", flush=True)


def main(out: str, locales: str, n: int) -> None:
    plain, german = ordinary(locales), ordinary(locales, ("de",))
    print(len(plain), "ordinary lines")
    # What sentences of other forms would give: a model of four fifths of the frames, measured on the rest.
    seen = [f for i, f in enumerate(WITH) if i % 5], [f for i, f in enumerate(WITHOUT) if i % 5]
    other = train(n // 2, plain, german, *seen)
    show("other frames", evaluate(other, [sentence(plain, WITH[::5], WITHOUT[::5]) for _ in range(3000)]))
    model = train(n, plain, german)
    show("same frames, held out", evaluate(model, [sentence(plain) for _ in range(3000)]))
    with gzip.open(out, "wt") as f:
        json.dump({"weights": model.weights, "words": sorted(model.words), "announcing": sorted(model.announcing)}, f, ensure_ascii=False)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]) if len(sys.argv) > 3 else 40_000)
