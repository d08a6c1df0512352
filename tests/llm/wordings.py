"""Wordings of residue and of speech about it, written down before the rules that judge them.

They are common wordings of servers, browsers, programs and templates, and what
people write about them; none is taken from the test tables. ``half`` splits
them by a checksum: the rules were written with the first half in view, and the
second half is only measured.
"""

from zlib import crc32

SCRIPTS = """HTTP pages need JavaScript to be turned on.
JavaScript seems to be disabled in your browser.
Please switch JavaScript on to continue.
You must enable JavaScript in order to use this site.
This page uses JavaScript. Please turn it on in the settings of your browser.
JavaScript is required to view this page.
For full functionality of this site it is necessary to enable JavaScript.
Enable JavaScript and cookies to continue
JavaScript is not available.
We've detected that JavaScript is disabled in this browser.
Your browser has JavaScript turned off or does not support it.
This application requires JavaScript to run.
Scripts are blocked by your mail client, so this message cannot be displayed.
Sorry, this newsletter cannot be shown without JavaScript.
You are seeing this because scripting is deactivated.
Just a moment... Please turn JavaScript on and reload the page.
Bitte schalten Sie JavaScript ein, um die Seite zu sehen.
JavaScript ist in Ihrem Browser deaktiviert.
Diese Anwendung benötigt JavaScript.
Zum Anzeigen dieses Inhalts muss JavaScript erlaubt sein.
JavaScript est désactivé dans votre navigateur.
Vous devez activer JavaScript pour utiliser cette application.
Ce site nécessite JavaScript pour fonctionner.
JavaScript está desactivado en su navegador.
Debe habilitar JavaScript para usar esta aplicación.
Es necesario activar JavaScript para continuar.
Você precisa ativar o JavaScript para ver esta página.
O JavaScript está desativado no seu navegador.
JavaScriptを有効にしてください。
このページを表示するにはJavaScriptが必要です。
कृपया अपने ब्राउज़र में JavaScript सक्षम करें।
इस पेज को देखने के लिए JavaScript चालू होना चाहिए।"""

ERROR = """HTTP Status 404 - Not Found
404 Page not found
HTTP Error 503. The service is unavailable.
Error 500: Internal Server Error
502 Bad Gateway nginx
504 Gateway Time-out
403 Forbidden You don't have permission to access this resource.
401 Unauthorized
HTTP/1.1 400 Bad Request
Access to this page has been denied.
The page you requested could not be found.
Sorry, the page you are looking for doesn't exist.
This page isn't working right now.
The server encountered an internal error and was unable to complete your request.
The resource you are looking for has been removed or is temporarily unavailable.
This webpage is not available
Unable to connect to the database server.
An unexpected error has occurred. Please try again later.
Oops! Something went wrong on our end.
The connection has timed out
Your connection was interrupted
The site is down for maintenance. Please check back soon.
Service temporarily unavailable due to maintenance downtime.
Application error: a server-side exception has occurred.
Whoops, looks like something went wrong.
The document has moved here.
Session timed out. Please log in again.
Parse error: syntax error, unexpected end of file
Warning: Undefined variable $name in /var/www/html/mail.php on line 12
Fatal error: Allowed memory size exhausted
Exception in thread "main" java.lang.NullPointerException
TypeError: Cannot read properties of undefined (reading 'name')
ReferenceError: customer is not defined
panic: runtime error: index out of range
Template error: variable not found while rendering
ModuleNotFoundError: No module named 'mailer'
ORA-00942: table or view does not exist
Segmentation fault (core dumped)
SQLSTATE[HY000] [2002] Connection refused
Erreur 404 : la page demandée n'existe pas
Erreur 500 - erreur interne du serveur
Accès refusé
La page que vous cherchez est introuvable.
Le service est temporairement indisponible.
Fehler 404 - Seite nicht gefunden
Die angeforderte Seite konnte nicht gefunden werden.
Der Dienst ist vorübergehend nicht verfügbar.
Es ist ein unerwarteter Fehler aufgetreten.
Zugriff verweigert
Error 404: página no encontrada
El servidor no está disponible en este momento.
Acceso denegado
Se ha producido un error inesperado.
Erro 404 - página não encontrada
Ocorreu um erro inesperado. Tente novamente mais tarde.
Acesso negado
お探しのページは見つかりませんでした。
サーバーエラーが発生しました。
アクセスが拒否されました。
अनुरोधित पेज नहीं मिला।
सर्वर में त्रुटि हुई।"""

FILLER = """Lorem ipsum dolor sit amet
Insert text here
Text goes here
Your content here
Add your message here
[TEXT TO FOLLOW]
Copy to come
Placeholder text
This is placeholder text, please replace.
Dummy copy for layout only
TBD
To be confirmed
To follow
Coming soon: final copy
Enter description here
Type something here
This is a sample paragraph. Replace it with your own text.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium
asdf asdf asdf asdf
qwerty qwerty uiop
blah blah blah
foo bar baz foo bar baz
test test test
xxxxx xxxxx xxxxx
Hier könnte Ihr Text stehen
Platzhaltertext, bitte ersetzen
Text folgt
Beispieltext für diesen Absatz
Texte à insérer ici
Insérez votre texte ici
Texto de ejemplo, sustituir
Inserte aquí su texto
Insira o seu texto aqui
Texto provisório a substituir
ここに文章を入力してください
यहाँ अपना संदेश लिखें"""

SLOT = """Dear XXXX, your balance is XX.
Dear ____, we write about your invoice.
Dear {{customer.firstName}},
Hello %FIRSTNAME%,
Hi ${user.name}, your parcel has left.
Your order #[ORDER_NUMBER] is confirmed.
Thank you for your payment of [AMOUNT].
Dear [Name],
Hi <FirstName>,
Hello {0}, your code is {1}.
Dear [[contact.salutation]],
Dear null,
Hello undefined, welcome back.
Your balance of NaN is due on Invalid Date.
Sehr geehrte Frau [Nachname],
Ihre Bestellung {{bestellnummer}} wurde versandt.
Bonjour {{ prenom }}, votre colis est parti.
Hola %%nombre%%, tu pedido está listo.
Olá [[nome]], seu pedido foi enviado.
{{名前}}様、ご注文ありがとうございます。
प्रिय {{नाम}}, आपका भुगतान मिला।
Invoice {invoice_no} for {customer_name}
Ref: <%= ticket.id %>
Kind regards, [Your Name]"""

SPEECH = """Our web form requires JavaScript, which the accessibility report criticises.
The printed letters said Dear undefined for forty customers.
Yesterday the portal showed a 404 for an hour, so we sent the list by fax.
Could you tell IT that the site says "Service unavailable" when I log in?
I had to enable JavaScript before the form would open.
The new trainee asked why JavaScript must be enabled for the portal, and I had no answer.
Our supplier's page was not found on Monday, but they fixed it by noon.
He wrote lorem ipsum in the draft and forgot to replace it.
Please replace the lorem ipsum in the brochure before it goes to print.
In the template we use {{first_name}} for the greeting.
The column [Amount] in the export should be called [Total].
What does %FIRSTNAME% stand for in the letter template?
My browser said access denied, but after a restart it worked.
We saw "500 Internal Server Error" twice while uploading the vouchers.
The auditors could not find the page with the totals.
The error in the March invoice has been corrected.
The database connection of the shop failed last night, orders are late.
I typed asdf into the search box and it crashed.
The voucher you asked about was not found in the folder.
Access to the warehouse was denied because the badge had expired.
The traceback you sent points to the exporter, I will look at it today.
Ann said the text was only a placeholder and would be written next week.
The date of the meeting is to be confirmed by the branch.
None of the customers answered, so the total is null and void.
The script for the call centre must be allowed by the manager first.
Das Portal zeigte gestern einen Fehler 500, inzwischen geht es wieder.
Wir müssen JavaScript auf den Kassenrechnern aktivieren, sagt der Dienstleister.
Im Brief steht noch der Platzhalter {{name}}, bitte vor dem Druck ändern.
Die Seite wurde gestern nicht gefunden, jetzt ist sie wieder da.
Le site affichait une erreur 404 ce matin, j'ai prévenu le support.
J'ai dû activer JavaScript pour ouvrir le formulaire.
El sitio dio un error 500 esta mañana, pero ya funciona.
Tuve que habilitar JavaScript para abrir el portal.
O portal mostrou um erro 503 ontem, mas já voltou.
昨日サイトで404エラーが出ましたが、直りました。
कल पोर्टल पर 404 त्रुटि आ रही थी, अब ठीक है।
The link goes to a page that no longer exists, can you send the file again?
See chapter 4: "Page not found" is shown when the id is wrong.
Use ${HOME}/exports as the folder in the config file.
The server room was unavailable during the repair.
I set the status to forbidden for closed periods, as we discussed.
Please send test data, not "test test test", when you try the import."""

ORDINARY = """Please find attached the list of open items for March.
The delivery was not complete, two boxes are missing.
We could not reach you by phone this morning.
Your request has been passed on to the branch.
The file you sent is incomplete, please send it again.
Please insert the paper into tray two.
The contract text follows next week.
Type B cartons are out of stock.
The resource plan for April is attached.
The service was excellent, thank you.
Error-free deliveries rose by 4 percent.
Copy of invoice 4711 enclosed.
The meeting room [B12] is booked from 9 to 10.
Access to the car park is from Mill Lane.
Bitte ersetzen Sie die defekte Ware.
Der Text der Vereinbarung ist beigefügt.
La página 3 del contrato está firmada.
Le service après-vente vous rappellera.
O texto do contrato segue em anexo.
ご確認ありがとうございます。
कृपया चालान की प्रति भेजें।
The gateway invoice is due on Friday.
Session three of the training starts at ten.
The connection flight leaves at noon.
Sample goods were sent by courier."""

KINDS = {"scripts": SCRIPTS, "error": ERROR, "filler": FILLER, "slot": SLOT, "speech": SPEECH, "ordinary": ORDINARY}


def half(n: int) -> list[tuple[str, str]]:
    """(kind, wording) of the first (0) or second (1) half."""
    return [(k, w) for k, text in KINDS.items() for w in text.split("\n") if crc32(w.encode()) % 2 == n]
