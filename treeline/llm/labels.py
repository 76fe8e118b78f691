"""The ten languages, notations of their names, seed texts, and the bounded labelled sample."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGS = ("en", "uk", "ru", "de", "fr", "es", "pt", "pl", "zh", "ja")

#: Rows of the labelled samples of documents and of source files that models are fitted on, and the longest text among them.
SAMPLE_ROWS = 4000
SAMPLE_FILES = 1000
SAMPLE_CHARS = 20_000

# Notations of each language besides its two-letter code (ISO 639-2, English and own names).
NOTATIONS = {
    "en": "eng english anglais englisch",
    "uk": "ukr ukrainian українська ua",
    "ru": "rus russian русский",
    "de": "deu ger german deutsch",
    "fr": "fra fre french français francais",
    "es": "spa spanish español espanol castellano",
    "pt": "por portuguese português portugues",
    "pl": "pol polish polski",
    "zh": "zho chi chinese 中文 汉语 漢語 cmn",
    "ja": "jpn japanese 日本語 jp",
}
CODE_OF = {x: code for code, names in NOTATIONS.items() for x in (code, *names.split())}


def label_code(label: str | None) -> str | None:
    """The code that a label names in any notation; None for missing or unknown ones."""
    if not label:
        return None
    whole = label.strip().lower()
    return CODE_OF.get(whole) or CODE_OF.get(re.split(r"[-_ .(]", whole, maxsplit=1)[0])


# Own seed texts, so that a language is known even where the labelled rows have little of it.
SEEDS = {
    "en": "This function returns the number of open connections and closes the ones that are no longer needed. Please check whether the value is empty before you use it. We should not change this part until the next release because other modules depend on it. The first argument is the name of the file, and the second one tells how many lines were read. If there is an error, it will be written to the log and the program goes on. Nobody knows why the old version was slower than the new one. It is better to keep the list sorted, so that searching takes less time. See the documentation for more details about these options. All rights are reserved by the authors, and copies must keep this notice. Do not edit this file by hand. There was a problem with the server when many users were working at the same time. This file was made automatically by a tool from a schema, please edit the source instead. The code below was generated; manual changes are lost on the next run and will be overwritten. Part of a set of tools. Distributed under open terms. Copyright by the contributors. Redistribution and use in source and binary form are permitted. There is no warranty of any kind. What does this do, and which of these should be used when it fails? Assume that the table holds only one entry while another process still keeps the lock. Choose the correct answer. Read the text and answer the question.",
    "uk": "Ця функція повертає кількість відкритих з'єднань і закриває ті, які більше не потрібні. Будь ласка, перевірте, чи значення не порожнє, перш ніж його використовувати. Не варто змінювати цю частину до наступного випуску, бо від неї залежать інші модулі. Перший аргумент є назвою файлу, а другий показує, скільки рядків було прочитано. Якщо станеться помилка, її буде записано до журналу, і програма піде далі. Ніхто не знає, чому стара версія була повільнішою за нову. Краще тримати список упорядкованим, щоб пошук забирав менше часу. Докладніше про ці параметри читайте в документації. Сьогодні сервер знову не відповідав, коли працювало багато користувачів. Її треба виправити якнайшвидше, інакше їхні дані зникнуть. Цей файл створено автоматично програмою за схемою, не редагуйте його вручну. Код нижче згенеровано; ручні зміни буде втрачено під час наступного запуску. Частина набору інструментів. Поширюється на відкритих умовах. Усі права належать авторам. Жодних гарантій не надається. Прочитайте текст і дайте відповідь на запитання. Який із записів буде першим, якщо він ще тримає замок? Оберіть правильне твердження. Припустімо, що таблиця має лише один запис.",
    "ru": "Эта функция возвращает количество открытых соединений и закрывает те, которые больше не нужны. Пожалуйста, проверьте, не пустое ли значение, прежде чем его использовать. Не стоит менять эту часть до следующего выпуска, так как от неё зависят другие модули. Первый аргумент является именем файла, а второй показывает, сколько строк было прочитано. Если произойдёт ошибка, она будет записана в журнал, и программа пойдёт дальше. Никто не знает, почему старая версия была медленнее новой. Лучше держать список упорядоченным, чтобы поиск занимал меньше времени. Подробнее об этих параметрах читайте в документации. Сегодня сервер опять не отвечал, когда работало много пользователей. Её нужно исправить как можно быстрее, иначе их данные исчезнут. Этот файл создан автоматически программой по схеме, не редактируйте его вручную. Код ниже сгенерирован; ручные изменения будут потеряны при следующем запуске. Часть набора инструментов. Распространяется на открытых условиях. Все права принадлежат авторам. Никаких гарантий не даётся. Прочитайте текст и ответьте на вопрос. Какая из записей будет первой, если он ещё держит замок? Выберите верное утверждение. Предположим, что в таблице только одна запись.",
    "de": "Diese Funktion gibt die Anzahl der offenen Verbindungen zurück und schließt die, welche nicht mehr gebraucht werden. Bitte prüfen, ob der Wert leer ist, bevor er verwendet wird. Wir sollten diesen Teil bis zur nächsten Ausgabe nicht ändern, weil andere Module davon abhängen. Das erste Argument ist der Name der Datei, und das zweite sagt, wie viele Zeilen gelesen wurden. Wenn ein Fehler auftritt, wird er ins Protokoll geschrieben, und das Programm läuft weiter. Niemand weiß, warum die alte Fassung langsamer war als die neue. Es ist besser, die Liste sortiert zu halten, damit die Suche weniger Zeit braucht. Mehr über diese Einstellungen steht in der Beschreibung. Heute hat der Server wieder nicht geantwortet, als viele Leute gleichzeitig arbeiteten. Diese Datei wurde automatisch von einem Programm aus einem Schema erzeugt, bitte nicht von Hand ändern. Änderungen gehen beim nächsten Lauf verloren. Teil einer Sammlung von Werkzeugen. Verteilt unter offenen Bedingungen. Alle Rechte liegen bei den Autoren. Es gibt keinerlei Gewähr. Lies den Text und beantworte die Frage. Welcher Eintrag kommt zuerst, falls er noch die Sperre hält? Wähle die richtige Aussage. Angenommen, die Tabelle hat nur einen Eintrag.",
    "fr": "Cette fonction renvoie le nombre de connexions ouvertes et ferme celles dont on n'a plus besoin. Merci de vérifier que la valeur n'est pas vide avant de l'utiliser. Il ne faudrait pas changer cette partie avant la prochaine version, car d'autres modules en dépendent. Le premier argument est le nom du fichier, et le second indique combien de lignes ont été lues. S'il y a une erreur, elle sera écrite dans le journal et le programme continue. Personne ne sait pourquoi l'ancienne version était plus lente que la nouvelle. Il vaut mieux garder la liste triée, pour que la recherche prenne moins de temps. Voir la documentation pour plus de détails sur ces options. Aujourd'hui le serveur ne répondait plus quand beaucoup de gens travaillaient en même temps. Ce fichier a été produit automatiquement par un outil à partir d'un schéma, ne le modifiez pas à la main. Les changements seront perdus à la prochaine exécution. Partie d'un ensemble d'outils. Distribué sous des termes ouverts. Tous les droits appartiennent aux auteurs. Aucune garantie n'est donnée. Lisez le texte et répondez à la question. Quelle entrée vient en premier s'il tient encore le verrou ? Choisissez la bonne réponse. Supposons que la table n'a qu'une seule entrée.",
    "es": "Esta función devuelve el número de conexiones abiertas y cierra las que ya no hacen falta. Por favor, compruebe que el valor no está vacío antes de usarlo. No deberíamos cambiar esta parte hasta la próxima versión, porque otros módulos dependen de ella. El primer argumento es el nombre del fichero, y el segundo dice cuántas líneas se han leído. Si hay un error, se escribirá en el registro y el programa sigue adelante. Nadie sabe por qué la versión antigua era más lenta que la nueva. Es mejor mantener la lista ordenada, para que la búsqueda lleve menos tiempo. Vea la documentación para más detalles sobre estas opciones. Hoy el servidor no respondía otra vez cuando mucha gente trabajaba al mismo tiempo. Este fichero fue generado automáticamente por una herramienta a partir de un esquema, no lo edite a mano. Los cambios se perderán en la próxima ejecución. Parte de un conjunto de herramientas. Distribuido bajo términos abiertos. Todos los derechos pertenecen a los autores. No hay garantía de ningún tipo. Lea el texto y responda a la pregunta. ¿Qué entrada viene primero si todavía mantiene el bloqueo? Elija la respuesta correcta. Supongamos que la tabla solo tiene una entrada.",
    "pt": "Esta função devolve o número de conexões abertas e fecha as que já não são necessárias. Por favor, verifique se o valor não está vazio antes de o usar. Não devemos mudar esta parte até a próxima versão, porque outros módulos dependem dela. O primeiro argumento é o nome do arquivo, e o segundo diz quantas linhas foram lidas. Se houver um erro, ele será escrito no registro e o programa segue em frente. Ninguém sabe por que a versão antiga era mais lenta do que a nova. É melhor manter a lista ordenada, para que a busca leve menos tempo. Veja a documentação para mais detalhes sobre estas opções. Hoje o servidor não respondia outra vez quando muita gente estava a trabalhar ao mesmo tempo. Este arquivo foi gerado automaticamente por uma ferramenta a partir de um esquema, não o edite à mão. As mudanças serão perdidas na próxima execução. Parte de um conjunto de ferramentas. Distribuído sob termos abertos. Todos os direitos pertencem aos autores. Não há garantia de nenhum tipo. Leia o texto e responda à pergunta. Qual entrada vem primeiro se ainda mantém o bloqueio? Escolha a resposta certa. Suponha que a tabela tem apenas uma entrada.",
    "pl": "Ta funkcja zwraca liczbę otwartych połączeń i zamyka te, które nie są już potrzebne. Proszę sprawdzić, czy wartość nie jest pusta, zanim zostanie użyta. Nie powinniśmy zmieniać tej części do następnego wydania, ponieważ zależą od niej inne moduły. Pierwszy argument jest nazwą pliku, a drugi mówi, ile wierszy przeczytano. Jeśli wystąpi błąd, zostanie zapisany w dzienniku, a program będzie działał dalej. Nikt nie wie, dlaczego stara wersja była wolniejsza niż nowa. Lepiej trzymać listę posortowaną, żeby szukanie zajmowało mniej czasu. Więcej o tych ustawieniach jest w dokumentacji. Dzisiaj serwer znowu nie odpowiadał, kiedy pracowało wielu użytkowników. Ten plik został utworzony automatycznie przez narzędzie na podstawie schematu, proszę nie zmieniać go ręcznie. Zmiany zostaną utracone przy następnym uruchomieniu. Część zestawu narzędzi. Rozpowszechniane na otwartych warunkach. Wszystkie prawa należą do autorów. Nie ma żadnej gwarancji. Przeczytaj tekst i odpowiedz na pytanie. Który wpis będzie pierwszy, jeśli nadal trzyma blokadę? Wybierz poprawną odpowiedź. Załóżmy, że tabela ma tylko jeden wpis.",
    "zh": "这个函数返回打开的连接数，并关闭不再需要的连接。使用之前请先检查这个值是否为空。在下一个版本之前，我们不应该修改这一部分，因为其他模块依赖于它。第一个参数是文件名，第二个参数说明读取了多少行。如果发生错误，它会被写入日志，程序继续运行。没有人知道为什么旧版本比新版本慢。最好让列表保持有序，这样查找所需的时间更少。有关这些选项的更多信息，请参阅文档。今天很多用户同时工作的时候，服务器又没有响应。此文件由工具根据模式自动生成，请不要手工修改。所做的更改将在下次运行时丢失。这是一组工具的一部分。按照开放条款分发。所有权利归作者所有。不提供任何形式的保证。阅读文本并回答问题。如果它仍然持有锁，哪一个条目排在最前面？请选择正确的说法。假设表中只有一个条目。",
    "ja": "この関数は開いている接続の数を返し、不要になった接続を閉じます。使う前に、値が空でないことを確認してください。ほかのモジュールがこれに依存しているため、次の版まではこの部分を変えないほうがよい。最初の引数はファイルの名前で、二番目は読み込んだ行の数を表す。エラーがあれば記録に書き込まれ、プログラムはそのまま続く。なぜ古い版が新しい版より遅かったのか、だれも知らない。検索の時間を短くするために、リストは並べておくべきです。これらの設定の詳細については説明書を見てください。今日も多くの利用者が同時に作業したとき、サーバーは応答しませんでした。このファイルは道具によって定義から自動的に作られたので、手で編集しないでください。変更は次の実行で失われます。道具一式の一部です。開かれた条件で配布されます。すべての権利は作者にあります。いかなる保証もありません。文章を読んで質問に答えなさい。まだ錠を保持している場合、どの項目が最初に来るか。正しい文を選びなさい。表には項目が一つしかないとする。",
}


def labelled_sample(documents: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(code, text) of at most ``rows`` labelled documents, the same ones each time.

    The bound holds whatever the size of the table; the labels may be wrong."""
    known = documents.select("doc_id", "lang", F.col("text").cast("string").alias("text")).filter(F.col("lang").isNotNull() & F.length("text").between(20, chars))
    got = _some(known, "doc_id", documents.count(), rows).select("lang", "text").collect()
    return [(code, r.text) for r in got if (code := label_code(r.lang))]


def code_sample(files: DataFrame, rows: int = SAMPLE_FILES, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(file, text) of at most ``rows`` source files, the same ones each time: code is what stands outside comments and literals."""
    known = files.select("file_id", "file", F.col("source").cast("string").alias("source")).filter(F.col("file").isNotNull() & F.length("source").between(20, chars))
    return [(r.file, r.source) for r in _some(known, "file_id", files.count(), rows).select("file", "source").collect()]


def _some(known: DataFrame, ident: str, size: int, rows: int) -> DataFrame:
    # a share of the ids first, so that no more than about ``rows`` texts ever leave the executors
    parts = 1_000_000
    below = min(parts, int(parts * rows / max(1, size)) + 1)
    return known.filter(F.pmod(F.xxhash64(ident), F.lit(parts)) < below).orderBy(F.xxhash64(ident), ident).limit(rows)
