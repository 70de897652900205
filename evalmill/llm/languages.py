"""Language posteriors from character n-gram naive Bayes.

The models are trained here, on one paragraph of seed text in each language and not on the corpus, so
rare wording and short replies rest on few n-grams; pairs asks for wide margins for that reason. Scripts
that one language mostly uses are told by their letters: each letter counts as the same sign.
"""

from __future__ import annotations

import re

import numpy as np

from . import ngrams

N, BUCKETS, FLOOR = 3, 1 << 16, 2e-5

#: General prose in each language, written for this purpose.
SEEDS = {
    "en": "The question is whether this will happen before the end of the month. I think that it is not likely, because there is little time left and the other side has not said anything about it. My answer is that they would have to change what they have been doing since last year, and most of the people who were asked about it do not believe in it. If you look at the numbers, you can see that only one of them was right. We should wait for more news from the city, which could still have an effect on our view. I must decline this request because of the content policy, and I cannot provide a probability here without a reliable source.",
    "de": "Die Frage ist, ob das noch vor dem Ende des Monats geschieht. Ich halte es nicht für wahrscheinlich, weil wenig Zeit bleibt und die andere Seite sich dazu nicht geäußert hat. Meine Antwort ist, dass sie ändern müssten, was sie seit dem letzten Jahr getan haben, und die meisten Leute, die man gefragt hat, glauben nicht daran. Wenn man die Zahlen ansieht, war nur eine davon richtig. Wir sollten auf weitere Nachrichten aus der Stadt warten, die sich noch auf unsere Sicht auswirken könnten. Leider kann ich dabei nicht helfen.",
    "fr": "La question est de savoir si cela arrivera avant la fin du mois. Je pense que ce n'est pas probable, parce qu'il reste peu de temps et que l'autre partie n'a rien dit à ce sujet. Ma réponse est qu'ils devraient changer ce qu'ils font depuis l'année dernière, et la plupart des gens qui ont été interrogés n'y croient pas. Si l'on regarde les chiffres, un seul d'entre eux était juste. Nous devrions attendre d'autres nouvelles de la ville, qui pourraient encore avoir un effet sur notre avis. Je ne peux pas répondre à cette demande.",
    "es": "La pregunta es si esto ocurrirá antes del final del mes. Creo que no es probable, porque queda poco tiempo y la otra parte no ha dicho nada al respecto. Mi respuesta es que tendrían que cambiar lo que han hecho desde el año pasado, y la mayoría de las personas a las que se preguntó no lo creen. Si se miran los números, solo uno de ellos era correcto. Deberíamos esperar más noticias de la ciudad, que todavía podrían tener un efecto en nuestra opinión. No puedo ayudar con esta petición.",
    "pt": "A questão é saber se isso vai acontecer antes do fim do mês. Acho que não é provável, porque resta pouco tempo e a outra parte não disse nada sobre o assunto. A minha resposta é que eles teriam de mudar o que têm feito desde o ano passado, e a maioria das pessoas que foram ouvidas não acredita nisso. Se olharmos para os números, só um deles estava certo. Devemos esperar por mais notícias da cidade, que ainda podem ter um efeito na nossa opinião. Não posso ajudar com este pedido. Até agora nada indica isso.",
    "it": "La questione è se questo accadrà prima della fine del mese. Penso che non sia probabile, perché manca poco tempo e l'altra parte non ha detto nulla al riguardo. La mia risposta è che dovrebbero cambiare quello che hanno fatto dall'anno scorso, e la maggior parte delle persone a cui è stato chiesto non ci crede. Se si guardano i numeri, solo uno di loro era giusto. Dovremmo aspettare altre notizie dalla città, che potrebbero ancora avere un effetto sul nostro parere. Non posso aiutare con questa richiesta. Finora nulla lo indica.",
    "nl": "De vraag is of dit nog voor het einde van de maand zal gebeuren. Ik denk dat het niet waarschijnlijk is, omdat er weinig tijd over is en de andere kant er niets over heeft gezegd. Mijn antwoord is dat ze zouden moeten veranderen wat ze sinds vorig jaar hebben gedaan, en de meeste mensen die werden gevraagd geloven er niet in. Als je naar de cijfers kijkt, was er maar een van hen juist. We moeten wachten op meer nieuws uit de stad, dat nog steeds een effect kan hebben op onze mening. Ik kan hier niet mee helpen.",
    "pl": "Pytanie brzmi, czy stanie się to przed końcem miesiąca. Myślę, że nie jest to prawdopodobne, ponieważ zostało mało czasu, a druga strona nic o tym nie powiedziała. Moja odpowiedź jest taka, że musieliby zmienić to, co robią od zeszłego roku, a większość ludzi, których o to zapytano, w to nie wierzy. Jeśli spojrzeć na liczby, tylko jedna z nich była właściwa. Powinniśmy poczekać na więcej wiadomości z miasta, które mogą jeszcze wpłynąć na nasz pogląd. Nie mogę w tym pomóc.",
    "sv": "Frågan är om detta kommer att hända före månadens slut. Jag tror inte att det är troligt, eftersom det är lite tid kvar och den andra sidan inte har sagt något om det. Mitt svar är att de skulle behöva ändra vad de har gjort sedan förra året, och de flesta människor som tillfrågades tror inte på det. Om man ser på siffrorna var bara en av dem rätt. Vi bör vänta på fler nyheter från staden, som fortfarande kan påverka vår syn. Jag kan inte hjälpa till med detta.",
    "tr": "Soru, bunun ay sonundan önce olup olmayacağıdır. Bunun olası olmadığını düşünüyorum, çünkü az zaman kaldı ve diğer taraf bu konuda hiçbir şey söylemedi. Cevabım, geçen yıldan beri yaptıklarını değiştirmeleri gerekeceğidir ve sorulan insanların çoğu buna inanmıyor. Sayılara bakarsanız, bunlardan yalnızca biri doğruydu. Şehirden gelecek daha fazla haberi beklemeliyiz, bu hâlâ görüşümüzü etkileyebilir. Bu konuda yardımcı olamam.",
    "ru": "Вопрос в том, произойдёт ли это до конца месяца. Я думаю, что это маловероятно, потому что времени осталось мало, а другая сторона ничего об этом не сказала. Мой ответ таков, что им пришлось бы изменить то, что они делали с прошлого года, и большинство людей, которых об этом спросили, в это не верят. Если посмотреть на цифры, только одна из них была верной. Нам следует подождать новых известий из города, которые ещё могут повлиять на наше мнение. Я не могу с этим помочь. Это составляет около половины всех таких случаев, и сообщения остаются противоречивыми. Суд ещё не вынес решения, поэтому оценка остаётся прежней.",
    "zh": "漢漢漢漢漢漢漢漢漢，漢漢漢漢漢漢漢漢。漢漢漢漢漢漢漢漢漢漢漢，漢漢漢漢漢漢漢漢漢漢。漢漢漢漢漢漢漢漢漢漢漢漢。漢漢漢漢，漢漢漢漢漢漢漢漢漢漢漢。",
    "ja": "漢漢かな漢かな漢漢かなかなかな。かなかな漢漢かな漢かなかなかな、漢漢かな漢漢かなかな。漢かなかな漢漢漢かなかなかな漢かなかな。",
    "ko": "한한 한한한 한한한 한한. 한한한한 한한 한한한 한한한, 한한한 한한 한한한한 한한. 한한 한한한 한한.",
    "cs": "Otázkou je, zda se to stane před koncem měsíce. Myslím, že to není pravděpodobné, protože zbývá málo času a druhá strana k tomu nic neřekla. Moje odpověď je, že by museli změnit to, co dělají od loňského roku, a většina lidí, kterých se na to ptali, tomu nevěří. Když se podíváte na čísla, jen jedno z nich bylo správné. Měli bychom počkat na další zprávy z města, které ještě mohou ovlivnit náš pohled. S tím bohužel nemohu pomoci.",
    "fi": "Kysymys on siitä, tapahtuuko tämä ennen kuun loppua. En usko, että se on todennäköistä, koska aikaa on vähän jäljellä eikä toinen osapuoli ole sanonut asiasta mitään. Vastaukseni on, että heidän pitäisi muuttaa sitä, mitä he ovat tehneet viime vuodesta lähtien, ja useimmat ihmiset, joilta kysyttiin, eivät usko siihen. Jos katsoo lukuja, vain yksi niistä oli oikein. Meidän pitäisi odottaa lisää uutisia kaupungista. En voi auttaa tässä.",
    "vi": "Câu hỏi là liệu điều này có xảy ra trước cuối tháng hay không. Tôi nghĩ rằng điều đó không có khả năng, vì thời gian còn lại rất ít và bên kia chưa nói gì về việc này. Câu trả lời của tôi là họ sẽ phải thay đổi những gì họ đã làm từ năm ngoái, và hầu hết những người được hỏi không tin vào điều đó. Nếu nhìn vào các con số, chỉ có một trong số đó là đúng. Chúng ta nên chờ thêm tin tức từ thành phố. Tôi không thể giúp việc này.",
    "da": "Spørgsmålet er, om det vil ske inden udgangen af måneden. Jeg tror ikke, at det er sandsynligt, fordi der er kun lidt tid tilbage, og den anden side har ikke sagt noget om det. Mit svar er, at de skulle ændre det, de har gjort siden sidste år, og de fleste mennesker, der blev spurgt, tror ikke på det. Hvis man ser på tallene, var kun et af dem rigtigt. Vi bør vente på flere nyheder fra byen. Jeg kan ikke hjælpe med dette.",
    "hu": "A kérdés az, hogy ez megtörténik-e a hónap vége előtt. Úgy gondolom, hogy nem valószínű, mert kevés idő maradt, és a másik fél nem mondott róla semmit. A válaszom az, hogy meg kellene változtatniuk azt, amit tavaly óta csinálnak, és a legtöbb megkérdezett ember nem hisz benne. Ha megnézzük a számokat, csak az egyik volt helyes. Várnunk kellene további hírekre a városból. Sajnos ebben nem tudok segíteni.",
    "ro": "Întrebarea este dacă acest lucru se va întâmpla înainte de sfârșitul lunii. Cred că nu este probabil, pentru că a rămas puțin timp, iar cealaltă parte nu a spus nimic despre asta. Răspunsul meu este că ar trebui să schimbe ceea ce fac de anul trecut, iar cei mai mulți dintre oamenii întrebați nu cred în asta. Dacă ne uităm la cifre, doar una dintre ele era corectă. Ar trebui să așteptăm mai multe știri din oraș. Nu pot ajuta cu această cerere.",
    "id": "Pertanyaannya adalah apakah hal ini akan terjadi sebelum akhir bulan. Saya pikir itu tidak mungkin, karena waktu yang tersisa sedikit dan pihak lain belum mengatakan apa pun tentang hal itu. Jawaban saya adalah bahwa mereka harus mengubah apa yang telah mereka lakukan sejak tahun lalu, dan sebagian besar orang yang ditanya tidak percaya akan hal itu. Jika kita melihat angka-angkanya, hanya satu yang benar. Kita harus menunggu berita lain dari kota. Saya tidak dapat membantu dengan permintaan ini.",
    "uk": "Питання в тому, чи станеться це до кінця місяця. Я думаю, що це малоймовірно, бо часу залишилося мало, а інша сторона нічого про це не сказала. Моя відповідь така, що їм довелося б змінити те, що вони робили з минулого року, і більшість людей, яких про це запитали, у це не вірять. Якщо подивитися на цифри, лише одна з них була правильною. Нам слід почекати нових звісток із міста. Я не можу з цим допомогти.",
    "ar": "السؤال هو ما إذا كان هذا سيحدث قبل نهاية الشهر. أعتقد أنه غير محتمل لأن الوقت المتبقي قليل ولم يقل الطرف الآخر شيئا عن ذلك. لا أستطيع المساعدة في هذا الطلب. يجب أن ننتظر المزيد من الأخبار.",
}
#: Scripts told by their letters alone: the first and last code point of each, and its language or name.
_SCRIPTS = {"el": (0x370, 0x3FF), "hy": (0x530, 0x58F), "he": (0x590, 0x5FF), "hi": (0x900, 0x97F), "bn": (0x980, 0x9FF), "pa": (0xA00, 0xA7F), "gu": (0xA80, 0xAFF), "ta": (0xB80, 0xBFF), "te": (0xC00, 0xC7F), "kn": (0xC80, 0xCFF),
            "ml": (0xD00, 0xD7F), "si": (0xD80, 0xDFF), "th": (0xE00, 0xE7F), "lo": (0xE80, 0xEFF), "bo": (0xF00, 0xFFF), "my": (0x1000, 0x109F), "ka": (0x10A0, 0x10FF), "am": (0x1200, 0x137F), "km": (0x1780, 0x17FF)}
_SIGN = {k: next(chr(c) for c in range(a, b + 1) if chr(c).isalpha() and chr(c) == chr(c).lower()) for k, (a, b) in _SCRIPTS.items()}
SEEDS |= {k: " ".join(c * n for n in (2, 5, 3, 7, 4, 1, 6, 8, 3, 5)) + "." for k, c in _SIGN.items()}
LANGUAGES = list(SEEDS)

_QUOTED = re.compile(r"„[^“”\"]*(?:[“”\"]|$)|“[^”]*(?:”|$)|«[^»]*(?:»|$)|\"[^\"\n]*\"|\\boxed\{[^}]*\}|\\\w+|<[^>]{1,40}>|&\w+;|\{[^}]*\}")
_NAME = re.compile(r"(?<=[^\W\d_A-Z] )[A-ZÀ-Þ][\w'’]*(?: [A-ZÀ-Þ][\w'’]*)*")
_HAN, _KANA, _HANGUL = re.compile(r"[㐀-鿿豈-﫿]"), re.compile(r"[぀-ヿ]"), re.compile(r"[가-힯]")
_SCRIPT = {k: re.compile(f"[{chr(a)}-{chr(b)}]+") for k, (a, b) in _SCRIPTS.items()}
_RARE = re.compile("[\u0370-\u03ff\u0530-\u05ff\u0900-\u137f\u1780-\u17ff]")
_OTHER = re.compile(r"[\W\d_]+")


def prose(text: str) -> str:
    """What tells a text's language: its own words, without quotations, answers, names and numbers."""
    t = _NAME.sub(" ", _QUOTED.sub(" ", text))
    if _RARE.search(t):
        for k, letters in _SCRIPT.items():
            t = letters.sub(lambda m, c=_SIGN[k]: c * len(m.group()), t)
    t = _HANGUL.sub("한", _KANA.sub("か", _HAN.sub("漢", t)))
    return f" {_OTHER.sub(' ', t.lower()).strip()} "


def seed_counts() -> np.ndarray:
    """Counts of each language's seed, one row per language."""
    return np.stack([ngrams.count_texts([prose(s)], N, BUCKETS) for s in SEEDS.values()])


def model() -> np.ndarray:
    """Log probabilities per language."""
    seeds = seed_counts()
    return np.log(seeds / seeds.sum(axis=1, keepdims=True) + FLOOR).astype(np.float32)


def posteriors(texts: list[str | None], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log posterior per text and language, up to a constant; n-grams per text). NULLs have no n-grams."""
    return ngrams.text_scores([prose(t or "") for t in texts], N, logp)
