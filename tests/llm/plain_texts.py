"""Sentences written by hand, apart from those the weights are trained on: [type|mention] marks the personal data."""

MARKED = """
[n|Maria Gonzalez] called this morning about the broken heater.
You can text me at [p|415-867-5309] after six.
Please forward the invoice to [e|accounts.payable@fernhill.co.uk] before Thursday.
The witness, [n|Theodore Ashdown], declined to comment.
Our landlord [n|Henrik Solberg] lives at [a|14 Kingsmead Avenue, Flat 3].
Employee badge issued to [n|Li Xiaoming], passport [i|EK4491027].
Her social security number is [i|517-44-9023] and must stay out of the log.
Kontakt: [n|Sabine Krause], Tel. [p|+49 40 7765 210], Mail [e|s.krause@elbtal.de]
Das Paket geht an [a|Lindenallee 27, 50668 Köln].
Unser Kollege [n|Matthias Vogt] hat den Fehler gefunden.
Je suis [n|Hélène Marchand] et mon téléphone est le [p|+33 6 12 34 56 78].
Nous livrons au [a|18, rue des Acacias] demain.
Le rapport de [n|Philippe Garnier] est en retard.
Me llamo [n|Rocío Estévez] y mi DNI es [i|45219876K].
El taller está en [a|Calle Velázquez 61].
Escríbeme a [e|rocio.estevez@correo.es] cuando puedas.
Звонила [n|Ольга Морозова], оставила номер [p|+7 912 345-67-89].
{"first_user": {"name": "[n|Grzegorz Malik]", "email": "[e|gmalik@poczta.pl]"}}
curl -X POST -d "phone=[p|(312) 555-7788]" http://127.0.0.1:8000/contacts
git commit --author "[n|Freya Lindqvist] <[e|freya@nordlys.se]>"
UPDATE users SET full_name = '[n|Dominic Okeke]' WHERE id = 4;
Minutes taken by [n|Rosalind Achebe]; present were [n|Tom Barker] and [n|Yusuf Demirci].
We owe this idea to [n|Ingeborg Maass].
Call [n|Bernadette] before you deploy anything.
[n|Callum] said the cache was stale.
Yesterday I had lunch with [n|Priyanka].
Sincerely, [n|Walter J. Hempstead]
The form was signed by Mrs. [n|Adaobi Nwosu] on Monday.
Applicant: [n|VINCENT MOREAU]
owner: [n|lucinda brathwaite]
The courier left it at [a|220 Thistlewood Lane].
Ship to [a|7 Harbour Road, Unit 12] please.
Steuer-ID [i|47 036 892 815] steht im Antrag.
National Insurance number: [i|JK 48 20 11 B]
reply-to [e|no.reply+tickets@helpdesk.example.com]
[e|kim_lee77@post.kr] asked twice
My mobile: [p|07812 445 901].
Dial [p|1-800-422-7799] for support.
Sprich bitte mit Frau [n|Annegret Pohl].
Il dottor [n|Lorenzo Bassani] ha chiamato.
Prof. [n|Edmund Fairweather] reviewed chapter two.
"Ask [n|Ngaire] whether the tests pass," he said.
The server at 10.44.7.129 rejected the request.
Upgrade to version 4.12.907 and rerun.
Order 4471-22-0098 shipped in 3 parcels.
Session 88213-40417 timed out after 45000 ms.
Fixed in commit 9f8e7d6c5b4a.
npm install fails on Windows.
{"command": "docker compose up"}
{"command":"yarn build","cwd":"/srv/app"}
{"query":"open issues","limit":10}
git status shows nothing to commit.
Thank You for reading the Release Notes.
We moved the demo from New York to Hong Kong.
Kafka and Postgres share one volume.
The Fibonacci sequence test is flaky.
See Main Menu, then File Options.
The Gaussian kernel blurs the preview.
Will this ever compile?
Mark the task as done and bill it to ops.
Quicksort beats Bubble Sort here.
ssh admin@build-07 and run uptime
clone git@example.org:tools/engine.git first
decorated with @property and @cached_property
`HttpClientFactory` creates `RetryPolicy` objects.
trace 6b1f4c8e-2f0d-4a77-9c55-0d9e8a7b6c5d ended early
The May figures are in sheet 3.
Der Dienst startet nach dem Neustart nicht mehr.
La compilation échoue sur la branche principale.
El servidor no responde desde ayer.
Сборка прошла без ошибок.
epoch 1702309981 equals 2023-12-11T15:53:01Z
resize it to 1280x720 pixels
Lane 3 of the pool is closed.
Drive letters are not supported.
Street View tiles load slowly.
cargo build --release
error[E0382]: borrow of moved value
"""
KINDS = {"n": "person_name", "p": "phone", "e": "email", "a": "street_address", "i": "identity_number"}


def marked() -> list[tuple[str, list[tuple[int, int, str]]]]:
    import re

    out = []
    for line in MARKED.strip().split("\n"):
        text, gold = "", []
        for part in re.split(r"(\[[npeai]\|[^\]]+\])", line):
            if part[:1] == "[" and part[2:3] == "|":
                gold.append((len(text), len(text) + len(part) - 4, KINDS[part[1]]))
                part = part[3:-1]
            text += part
        out.append((text, gold))
    return out
