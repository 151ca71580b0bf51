"""Seed texts for the language model: everyday sentences written for this purpose."""

# A few common sentences and small words of each language.
SEEDS = {
    "en": "where is when was who is which river why how old how far what kind the house is near the river and we went there before the evening. what does this file do and why is it not open? you should read each line and check the result. keep the name short and return a new list of the values. it is known for the old market, where people sell bread and salt. i am sorry to hear that, maybe you can ask again. how many are there in all? write the name of the town first. he was born in a small town and grew up with his uncle. she could have been here, but they would rather wait until tomorrow. use another word when the first one fails. count the words, sort them by size, drop empty ones and show the last of them. no, you cannot do that with plain numbers. good night, sleep well. find print list sort file folder string number function loop if else for in len str int not and or true false none return def key lambda append update open move copy remove change calc move",
    "de": "wo liegt der ort? wo ist das? wer ist das? wann wurde sie geboren? wie alt ist er? warum nicht? welche stadt liegt dort das haus steht am fluss und wir sind vor dem abend dort gewesen. was macht diese datei und warum ist sie nicht offen? du solltest jede zeile genau lesen und dann das ergebnis prüfen. der ort ist für seinen alten markt bekannt, wo die leute brot und salz verkaufen. es tut mir leid, vielleicht kannst du noch einmal fragen. wie viele sind es insgesamt? sie wurde in einer kleinen stadt geboren und wuchs bei ihrem onkel auf. am besten kannst du mit dem nachbarn sprechen und alles zählen bevor der tag endet. zuerst muss man die größte zahl suchen, sonst geht es nicht. ich habe keine zeit und bin nicht sicher, ob er heute kommt. wer hat es gegründet, nachdem die brücke fertig war? ungefähr kilometer von der stadt entfernt. auf dem markt gekauft, guten morgen, schöne grüße und vielen dank",
    "es": "¿dónde está? ¿cuándo nació? ¿quién fue? ¿cuál es? ¿por qué no? ¿cómo se llama? la casa está junto al río y estuvimos allí antes de la noche. ¿qué hace este archivo y por qué no está abierto? después deberías leer cada línea con cuidado y comprobar el resultado. el pueblo es conocido por su antiguo mercado, donde la gente vende pan y sal. lo siento, quizás puedas preguntar otra vez. ¿cuántos hay en total? nació en una ciudad pequeña y creció con su tío. también se puede hablar con el vecino y contar todo antes de que acabe el día porque de otro modo no funciona. primero hay que buscar el número más grande. ¿dónde queda? ¿quién es esta persona que repara relojes y vende fruta los domingos? vive cerca del bosque con muchas cabras a unos kilómetros. lo mejor es viajar hasta allí, muchas gracias y buenos días",
    "fr": "où est la ville ? quand est-elle née ? qui a fondé ? quel âge ? pourquoi pas ? comment faire ? la maison se trouve au bord de la rivière et nous y étions avant le soir. que fait ce fichier et pourquoi n'est-il pas ouvert ? ensuite tu devrais lire chaque ligne avec soin et vérifier le résultat. le village est connu pour son vieux marché, où les gens vendent du pain et du sel. je suis désolé, peut-être pouvez-vous demander encore une fois. combien y en a-t-il en tout ? elle est née dans une petite ville et a grandi chez son oncle. il vaut mieux parler avec le voisin et tout compter avant la fin du jour car sinon ça ne marche pas. d'abord il faut aller jusqu'à la ville et chercher le plus grand nombre. qui est-ce ? il tient une boutique et chante le soir avec ses voisins. cherche les clefs de la maison, où se trouve le kilomètre, merci beaucoup et bonjour",
    "it": "dove sta? quando è nato? chi era? quale città? perché no? come si chiama? la casa si trova vicino al fiume e siamo stati lì prima di sera. che cosa fa questo file e perché non è aperto? poi dovresti leggere ogni riga con cura e controllare il risultato. il paese è noto per il suo vecchio mercato, dove la gente vende pane e sale. mi dispiace, forse puoi chiedere un'altra volta. quanti sono in tutto? è nata in una piccola città ed è cresciuta con lo zio. si può anche parlare con il vicino e contare tutto di nuovo prima della fine del giorno perché altrimenti non funziona. prima bisogna cercare il numero più grande e andare fino alla città. dove si trova? chi ha fondato questo luogo? molte grazie e buongiorno, aprire il file, chiudere la porta",
    "pt": "onde está? quando nasceu? quem foi? qual é? por que não? como se chama? a casa fica perto do rio e estivemos lá antes da noite. o que faz este arquivo e por que não está aberto? depois você deve ler cada linha com cuidado e conferir o resultado. a vila é conhecida por seu antigo mercado, onde as pessoas vendem pão e sal. sinto muito, talvez possa perguntar outra vez. quantos são ao todo? ela nasceu em uma cidade pequena e cresceu com o tio. também se pode falar com o vizinho e contar tudo de novo antes do fim do dia porque senão não funciona. primeiro é preciso procurar o maior número e ir até a cidade. onde fica? quem fundou este lugar? muito obrigado e bom dia, abrir o arquivo, fechar a porta, não há mais nada",
    "nl": "waar is dat? wanneer was het? wie is dat? welke stad? waarom niet? hoe oud? het huis staat bij de rivier en wij waren daar voor de avond. wat doet dit bestand en waarom is het niet open? daarna moet je elke regel goed lezen en het resultaat controleren. het dorp is bekend om zijn oude markt, waar de mensen brood en zout verkopen. het spijt me, misschien kun je het nog een keer vragen. hoeveel zijn er in totaal? zij werd geboren in een kleine stad en groeide op bij haar oom. je kunt ook met de buurman praten en alles opnieuw tellen voordat de dag voorbij is, want anders werkt het niet. eerst moet je naar de stad gaan en het grootste getal zoeken. waar ligt het? wie heeft deze plaats gesticht? hartelijk dank en goede morgen, het beste is om te wachten",
    "sv": "var är det? när föddes hon? vem är det? vilken stad? varför inte? hur gammal? huset ligger vid floden och vi var där före kvällen. vad gör den här filen och varför är den inte öppen? sedan borde du läsa varje rad noga och kontrollera svaret. byn är känd för sin gamla marknad, där folk säljer bröd och salt. jag är ledsen, kanske kan du fråga en gång till. hur många är det sammanlagt? hon föddes i en liten stad och växte upp hos sin farbror. man kan också prata med grannen och räkna allt igen innan dagen är slut, annars går det inte. först måste man resa till staden och söka det största talet. var ligger det? vem grundade den här platsen? tack så mycket och god morgon, öppna filen och stäng dörren",
    "da": "hvor er det? hvornår blev hun født? hvem er det? hvilken by? hvorfor ikke? hvor gammel? huset ligger ved floden, og vi var der før aften. hvad gør denne fil, og hvorfor er den ikke åben? bagefter bør du læse hver linje nøje og kontrollere resultatet. byen er kendt for sit gamle marked, hvor folk sælger brød og salt. jeg er ked af det, måske kan du spørge igen. hvor mange er der i alt? hun blev født i en lille by og voksede op hos sin onkel. man kan også tale med naboen og tælle det hele igen, før dagen er slut, ellers virker det ikke. først skal du rejse til byen og finde det største tal. hvor ligger det? mange tak og god morgen, åbn filen og luk døren",
    "no": "hvor er det? når ble hun født? hvem er det? hvilken by? hvorfor ikke? hvor gammel? huset ligger ved elven, og vi var der før kvelden. hva gjør denne filen, og hvorfor er den ikke åpen? etterpå bør du lese hver linje nøye og sjekke resultatet. byen er kjent for sitt gamle marked, der folk selger brød og salt. jeg er lei meg, kanskje kan du spørre igjen. hvor mange er det i alt? hun ble født i en liten by og vokste opp hos onkelen sin. man kan også snakke med naboen og telle alt på nytt før dagen er over, ellers virker det ikke. først må du reise til byen og finne det største tallet. takk og god morgen, åpne filen og lukk døra",
    "pl": "gdzie to jest? kiedy się urodził? kto to jest? które miasto? dlaczego nie? jak się nazywa? dom stoi nad rzeką i byliśmy tam przed wieczorem. co robi ten plik i dlaczego nie jest otwarty? potem należy uważnie przeczytać każdą linię i sprawdzić wynik. wieś jest znana ze starego targu, gdzie ludzie sprzedają chleb i sól. przykro mi, może możesz zapytać jeszcze raz. ile ich jest razem? urodziła się w małym mieście i dorastała u wuja. można też porozmawiać z sąsiadem i policzyć wszystko od nowa, zanim skończy się dzień, bo inaczej nie działa. najpierw trzeba pojechać do miasta i znaleźć największą liczbę. gdzie leży? kto założył to miejsce? dziękuję bardzo i dzień dobry, otworzyć plik, zamknąć drzwi",
    "cs": "kde to je? kdy se narodil? kdo to je? které město? proč ne? jak se jmenuje? dům stojí u řeky a byli jsme tam před večerem. co dělá tento soubor a proč není otevřený? potom byste měl pozorně přečíst každý řádek a zkontrolovat výsledek. vesnice je známá svým starým trhem, kde lidé prodávají chléb a sůl. je mi líto, možná se můžete zeptat ještě jednou. kolik jich je celkem? narodila se v malém městě a vyrůstala u strýce. také je možné mluvit se sousedem a všechno znovu spočítat, než skončí den, protože jinak to nefunguje. nejprve je třeba jet do města a najít největší číslo. kde leží? kdo založil toto místo, asi kilometrů od města? děkuji mnohokrát a dobré ráno",
    "tr": "ev nehrin yanında ve akşamdan önce oradaydık. bu dosya ne yapar ve neden açık değil? sonra her satırı dikkatle okuyup sonucu kontrol et. köy eski pazarıyla bilinir, orada insanlar ekmek ve tuz satar. üzgünüm, belki bir daha sorabilirsin. hepsi kaç tane? küçük bir şehirde doğdu ve amcasının yanında büyüdü. istersen komşuyla konuşup hepsini yeniden say ve akşama kadar bekle, yoksa olmaz. önce şehre gidip en büyük sayıyı bul. nerede? bu yeri kim kurdu? çok teşekkürler ve günaydın, dosyayı açıp kapıyı kapat, daha sonra gel",
    "fi": "talo on joen rannalla ja olimme siellä ennen iltaa. mitä tämä tiedosto tekee ja miksi se ei ole auki? sitten sinun pitäisi lukea jokainen rivi huolellisesti ja tarkistaa tulos. kylä tunnetaan vanhasta torista, jossa ihmiset myyvät leipää ja suolaa. olen pahoillani, ehkä voit kysyä uudelleen. montako niitä on yhteensä? hän syntyi pienessä kaupungissa ja kasvoi setänsä luona. voit myös puhua naapurin kanssa ja laskea kaiken uudelleen ennen kuin päivä päättyy, muuten se ei toimi. ensin täytyy mennä kaupunkiin ja etsiä suurin luku. missä se on? kiitos paljon ja hyvää huomenta",
    "hu": "a ház a folyó mellett áll, és este előtt ott voltunk. mit csinál ez a fájl, és miért nincs megnyitva? aztán figyelmesen el kell olvasni minden sort, és ellenőrizni az eredményt. a falu a régi piacáról ismert, ahol az emberek kenyeret és sót árulnak. sajnálom, talán kérdezd meg még egyszer. hány van összesen? egy kis városban született és a nagybátyjánál nőtt fel. beszélhetsz a szomszéddal is, és újra megszámolhatsz mindent, mielőtt véget ér a nap, különben nem működik. először el kell utazni a városba, és megkeresni a legnagyobb számot. hol van? köszönöm szépen és jó reggelt",
    "ro": "casa se află lângă râu și am fost acolo înainte de seară. ce face acest fișier și de ce nu este deschis? apoi ar trebui să citești fiecare rând cu grijă și să verifici rezultatul. satul este cunoscut pentru vechea sa piață, unde oamenii vând pâine și sare. îmi pare rău, poate poți întreba încă o dată. câte sunt în total? s-a născut într-un oraș mic și a crescut la unchiul său. se poate vorbi și cu vecinul și număra totul din nou înainte să se termine ziua, altfel nu merge. mai întâi trebuie să mergi până la oraș și să cauți cel mai mare număr. unde se află? mulțumesc mult și bună dimineața",
    "id": "rumah itu berada di dekat sungai dan kami ada di sana sebelum malam. apa yang dilakukan berkas ini dan mengapa tidak terbuka? kemudian anda harus membaca setiap baris dengan teliti dan memeriksa hasilnya. desa itu dikenal karena pasar lamanya, tempat orang menjual roti dan garam. maaf, mungkin anda bisa bertanya sekali lagi. berapa semuanya? dia lahir di kota kecil dan dibesarkan oleh pamannya. bisa juga berbicara dengan tetangga dan menghitung semuanya lagi sebelum hari berakhir, karena kalau tidak maka tidak jalan. pertama harus pergi ke kota dan mencari angka terbesar. di mana letaknya? terima kasih banyak dan selamat pagi",
    "ru": "дом стоит у реки, и мы были там до вечера. что делает этот файл и почему он не открыт? потом следует внимательно прочитать каждую строку и проверить результат. можно также поговорить с соседом и всё пересчитать до конца дня. сначала нужно найти наибольшее число. где находится? спасибо большое и доброе утро",
    "uk": "будинок стоїть біля річки, і ми були там до вечора. що робить цей файл і чому він не відкритий? потім слід уважно прочитати кожен рядок і перевірити результат. можна також поговорити із сусідом і все перерахувати до кінця дня. спочатку треба знайти найбільше число. де знаходиться? дуже дякую і доброго ранку",
    "el": "το σπίτι είναι δίπλα στο ποτάμι και ήμασταν εκεί πριν το βράδυ. τι κάνει αυτό το αρχείο και γιατί δεν είναι ανοιχτό; μετά πρέπει να διαβάσεις κάθε γραμμή και να ελέγξεις το αποτέλεσμα. μπορείς επίσης να μιλήσεις με τον γείτονα πριν τελειώσει η μέρα. πού βρίσκεται; ευχαριστώ πολύ και καλημέρα",
    "ja": "まず大きい数を探して、結果を確かめます。次にファイルを開いて、もう一度数えます。できれば一行ずつ読んで、夕方までに終わらせます。どこにありますか。これは何ですか。ありがとうございます。",
    "zh": "房子在河边,我们晚上之前在那里。这个文件做什么,为什么没有打开?然后应该仔细读每一行并检查结果。也可以和邻居谈谈,再数一遍。谢谢你,早上好,在哪里?是谁建立的?",
    "ko": "집은 강 옆에 있고 우리는 저녁 전에 거기에 있었습니다. 이 파일은 무엇을 하고 왜 열려 있지 않습니까? 그 다음 각 줄을 읽고 결과를 확인하십시오. 감사합니다. 어디에 있습니까?",
    "ar": "البيت بجانب النهر وكنا هناك قبل المساء. ماذا يفعل هذا الملف ولماذا هو غير مفتوح؟ ثم يجب أن تقرأ كل سطر وتتحقق من النتيجة. يمكن أيضا التحدث مع الجار. شكرا جزيلا وصباح الخير. أين يقع؟",
    "hi": "घर नदी के पास है और हम शाम से पहले वहाँ थे। यह फ़ाइल क्या करती है और क्यों खुली नहीं है? फिर हर पंक्ति पढ़ो और परिणाम जाँचो। धन्यवाद और सुप्रभात। कहाँ है?",
}

# Ways of declining a request, and words of which each has one.
REFUSALS = {
    "en": {
        "texts": [
            "I must turn this request down", "Sorry, I must decline", "That falls outside what I am willing to write", "I won't be answering that", "I am afraid I cannot do this for you", "I would rather not say anything about it",
            "This is a request I have to refuse", "I am not willing to go on with this", "I can't help you with that", "I will not write this", "My rules do not let me answer this", "I have to say no to this one",
            "I do not feel able to reply to that", "Please ask someone else, I can't respond", "I am not the right one to answer such a question", "Unfortunately I am unable to assist", "It is not something that I can talk about",
            "I choose not to answer", "I am sorry, this is beyond what I may do", "I don't think I should answer that",
        ],
        "signs": "i me my sorry cannot unable decline refuse won",
    },
    "de": {
        "texts": [
            "Das kann ich leider nicht beantworten", "Tut mir leid, dabei kann ich nicht helfen", "Ich darf dazu nichts sagen", "Diese Bitte muss ich ablehnen", "Ich möchte darauf nicht antworten", "Dazu werde ich mich nicht äußern",
            "Als KI habe ich dazu keine Meinung", "Ich bin nicht in der Lage, das zu tun", "Meine Regeln erlauben mir das nicht", "Leider ist es mir nicht möglich zu antworten", "Ich kann dir damit nicht weiterhelfen", "Entschuldigung, das mache ich nicht",
        ],
        "signs": "ich mir mich meine leid leider entschuldigung",
    },
    "es": {
        "texts": [
            "Lo siento, no puedo ayudar con eso", "No puedo responder a esa pregunta", "No me está permitido hablar de esto", "Debo rechazar esta petición", "Prefiero no contestar", "No voy a responder a eso", "Como inteligencia artificial no tengo opiniones",
            "Mis normas no me permiten contestar", "No estoy en condiciones de hacerlo", "Me temo que no puedo hacer eso", "Lamento no poder ayudarte con esta tarea", "No soy capaz de dar una respuesta",
        ],
        "signs": "no me mis puedo siento lamento prefiero debo",
    },
    "fr": {
        "texts": [
            "Désolé, je ne peux pas vous aider", "Je ne peux pas répondre à cette question", "Je dois refuser cette demande", "Je préfère ne pas répondre", "Je ne suis pas en mesure de le faire", "Mes règles ne me permettent pas de répondre",
            "En tant qu'IA, je n'ai pas d'avis", "Il m'est impossible d'en parler", "Je ne vais pas répondre à cela", "Je crains de ne pas pouvoir faire cela", "Je regrette de ne pas pouvoir aider", "Je n'ai pas le droit d'en dire plus",
        ],
        "signs": "je ne me mes désolé regrette",
    },
}
