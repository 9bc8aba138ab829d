"""The small labelled table that the personal-data field is trained from.

One line a row; a marked piece is [[kind|text]]. All people, numbers and keys are made up.
"""

LINES = r"""
Call me at [[phone|(555) 201-3344]] after lunch.
Her office number is [[phone|555-318-2277]], ask for the lab.
Phone: [[phone|555 402 9912]]
Tel. [[phone|020 7946 0991]] or come by.
Reach the front desk on [[phone|(555) 640-1188]] or [[phone|(555) 640-1189]].
mobile [[phone|07700 900123]] works on Sundays
My new number: [[phone|555.772.0045]].
Fax [[phone|(555) 893-4410]], room 12.
You can phone [[phone|555-0142-771]] any time.
[[phone|(555) 010-7788]] is the number of the clinic
de la maison, [[phone|(412) 555-0187]] est le nouveau numéro
tel: [[phone|030 123 4567]]
Please call [[phone|555-123-4567]] before 5 pm.
whatsapp [[phone|555 987 6543]] thanks
The hotline [[phone|(800) 555-0199]] was busy.
Ask for Kim, [[phone|(555) 777-1212]].
Write to [[email|maria (at) example (dot) org]] for the minutes.
contact: [[email|jo.smith [at] example [dot] com]]
My address is [[email|kofi (at) mail (dot) example (dot) net]], thanks.
send it to [[email|team [at] lab [dot] example [dot] edu]] today
[[email|a.b (at) example (dot) com]] answers quickly
mail [[email|nina42 (at) example (dot) de]] please
or try [[email|info [at] shop [dot] example]] instead
write [[email|ada (at) example.org]] or come by
[[email|bob@localhost]] is only a test account
cron mails go to [[email|root@build7]] at night
token = "[[secret|9f8b2c4d6e1a7c3b5d9e8f7a6b5c4d3e]]"
the api_key: [[secret|AKx83hd92kfL02mdk39sPq71]] was revoked
password = [[secret|hunter2horse9staple4]]
secret: "[[secret|c0ffee1234abcd5678ef90aa12bb34cc56dd78ee]]"
export TOKEN=[[secret|ghx1A2b3C4d5E6f7G8h9I0j1K2l3]]
Authorization: Bearer [[secret|eyJh8bGc9iOiJ1IUzI1NiIsInR5c]]
key = '[[secret|7b1d3f5a9c2e4b6d8f0a1c3e5b7d9f2a]]' # rotate
Thus the token = "[[secret|1a2b3c4d5e6f7a8b9c0d1e2f3a4b5c6d7e8f9a0b]]" was left in.
TOKEN = "[[secret|A1B2C3D4E5F60718293A4B5C6D7E8F90A1B2C3D4]]"!! AND!! SO
y el token = "[[secret|44d1c0a95be7f2830c6b1a9de5f7743201acbe88]]" aquí
client_secret="[[secret|q8W2e6R1t9Y3u7I5o4P0a2S6d8F1]]"
We met on 12 March 2019 in room 204.
The price rose from 1,200 to 1,350 dollars.
Section 4.2.1 of version 10.0.3 says otherwise.
From 9:30 to 17:45 the shop was open.
Its ISBN is 978-3-16-148410-0, printed in 2004.
He scored 21 points and 11 rebounds, then 17-14 in the set.
On 2021-05-17 the 3rd edition sold 40,000 copies.
pages 112-118, volume 25 (2003), number 4
about 3.14159 of 100 (or 5 %)
order 4785380592391139 was shipped in 2 boxes
the parcel 980791576280 and 75367841 went missing
In (1998) and (2004) there were 12 of them.
Add 2 + 2 = 4 and 10 / 5 = 2.
x = 17; y = (3 - 1) * 4
the well-known state-of-the-art twenty-one
He said (at the end) that it was fine.
(see at least one) and [at most two] of these
The dot (a small one) was red.
the host 10.20.30.40 went down, and 192.168.1.77 too
card 4111 1111 1111 1111 expires 09/27
the mail ann.lee@mail3.example.org bounced
Room 555, floor 12, building 7-B, zip 90210-1234
the gene BRCA1 and the star HD209458b
flight LH4402, gate B22, seat 14C at 18:05
a 1920x1080 screen and 16GB of memory
the commit is in branch fix-1234 of release v2.14
A key idea is that the token of a word counts.
The secret of the house was its password to the past.
You may call it a phone or a key, it is the same.
At 5 at night, dot by dot, at the inn.
mail2 and box7 are names of 2 machines
!!! #### $$$ %%% &&& *** and !!! again
the*** of### and$$$ to%%% in&&& is*** it###
Only 3. Then 4. Then 15, 16 and 23.
Le 14 juillet 1789, à 10 h, 30 000 personnes.
Der 3. Oktober 1990 war ein Mittwoch.
La sección 12 tiene 340 páginas y 25 notas.
wordsofalengththatisunusualbutharmless and plain ones
Nothing to see here, just words and more words.
Lo que dice, y lo que no dice; todo es igual.
Die Straße ist lang, und der Weg ist weit.
On a dit que, peut-être, il viendra demain.
ratio 3:1, odds 15/2, and a 7-8-9 lock
tables 555 and 556; 200 of 1000; 123 or 456 or 789
"quoted words" and 'single ones' (in brackets) [and square ones]
It is 100-200 km from here, 50-60 % of the way.
A/B tests = good; C/D = bad: see above.
chapter 12 - 13 - 14, lines 100 to 2000
send word to [[email|lea (at) example (dot) org]] and then wait for as long as it takes, as all of us have to do
the code, that is, the plain one, and all the other ones that we keep in the house by the river, is of no use to us
nobody, not even the old man in the corner, knew what it was all about, and so they went home, one by one, in the rain
we were told, in so many words, that the way was long; we went on, all the same, and came to the sea
it was said, and said again, that no one, but no one, could have known of this, or of that, or of anything else at all
so it goes, on and on, day by day, with little to do, little to see, and less to say to those who stay
for those who stay, there is bread; for those who go, there is wine; for the rest, there is neither, nor will there be
word, word, word; and word upon word, then a pause, and then more words, all of them plain, none of them new
de la casa, de la calle, y de todo lo que hay en ella, no queda nada, ni una piedra, ni un árbol, ni una sombra
""".strip("\n").split("\n")
