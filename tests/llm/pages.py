"""Hand-written pages in shapes that the labelled pages do not have, each with the lines of its main text."""

P1 = "The council voted on Monday to build a bridge over the river, after years of debate."
P2 = "Work should begin in spring and take three years, the mayor told reporters in the town hall."
P3 = "Critics say that the money would be better spent on schools. A petition has five thousand names."
D1 = "Der Stadtrat hat am Montag beschlossen, eine neue Brücke über den Fluss zu bauen."
D2 = "Die Arbeiten sollen im Frühjahr beginnen und drei Jahre dauern, sagte die Bürgermeisterin."
F1 = "Le conseil a voté lundi la construction d'un pont sur la rivière, après des années de débat."
F2 = "Les travaux doivent commencer au printemps et durer trois ans, selon la mairie."
S1 = "El ayuntamiento votó el lunes la construcción de un puente sobre el río, tras años de debate."
S2 = "Las obras empezarán en primavera y durarán tres años, según la alcaldesa."

PAGES = {
    "bare text": (f"{P1} {P2} {P3}", [f"{P1} {P2} {P3}"]),
    "bare lines": (f"<html><body>{P1}<p>{P2}<p>{P3}</body></html>", [P1, P2, P3]),
    "no names": (f"<body><div><a href=/>Home</a> <a href=/a>World</a> <a href=/b>Sport</a></div><div><h1>A bridge at last</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div><a href=/t>Terms</a> <a href=/p>Privacy</a></div></body>", ["A bridge at last", P1, P2, P3]),
    "divs for paragraphs": (f'<div id="nav"><a href=1>Home</a><a href=2>News</a></div><div class="x1"><div class="t">A bridge at last for the town</div><div>{P1}</div><div>{P2}</div></div>', ["A bridge at last for the town", P1, P2]),
    "table layout": (f"<table width=100%><tr><td valign=top><a href=/>Home</a><br><a href=/n>News</a><br><a href=/l>Links</a></td><td><h2>A bridge at last</h2>{P1}<p>{P2}<p>{P3}</td></tr></table><p><small>Last updated 1999 by webmaster</small></p>", ["A bridge at last", P1, P2, P3]),
    "random names": (f'<div class="qz7"><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><section class="vv"><h1>A bridge at last</h1><p>{P1}</p><p>{P2}</p></section><div class="kkx"><ul><li><a href=4>Four</a><li><a href=5>Five</a></ul></div>', ["A bridge at last", P1, P2]),
    "comments under another name": (f'<article><h1>A bridge at last</h1><p>{P1}</p><p>{P3}</p></article><section id="respond"><h3>Leave a reply</h3><div><b>joe</b><p>I like it very much. Thanks for this.</p></div><div><b>ann</b><p>So do I.</p></div></section>', ["A bridge at last", P1, P3]),
    "german": (f'<header><a href="/">Der Bote</a></header><div class="artikel"><h1>Endlich eine Brücke</h1><p>{D1}</p><p>{D2}</p></div><div class="werbung"><p>Kaufen Sie jetzt neue Schuhe. Nur heute.</p></div><div id="kommentare"><h3>Kommentare</h3><p>Sehr schön. Danke.</p></div>', ["Endlich eine Brücke", D1, D2]),
    "french": (f'<nav><a href=/>Accueil</a></nav><div class="texte"><h1>Un pont enfin</h1><p>{F1}</p><p>{F2}</p></div><aside><h4>A lire aussi</h4><ul><li><a href=/x>Le vieux pont</a></ul></aside><footer>Mentions légales</footer>', ["Un pont enfin", F1, F2]),
    "spanish": (f'<div class="menu"><ul><li><a href=/>Inicio</a><li><a href=/d>Deportes</a></ul></div><main><h1>Por fin un puente</h1><p>{S1}</p><p>{S2}</p></main><div class="publicidad"><p>Compre zapatos nuevos.</p></div><section id="comentarios"><h3>Comentarios</h3><p>Muy bien.</p></section>', ["Por fin un puente", S1, S2]),
    "centred, with a rule": (f"<body><center><h1>A bridge at last</h1></center><hr><p>{P1}</p><p>{P2}</p><p>{P3}</p><hr><a href=/>Back</a> | <a href=/next>Next</a></body>", ["A bridge at last", P1, P2, P3]),
    "advert in the text": (f'<main><h1>A bridge at last</h1><p>{P1}</p><div class="ad-slot"><p>Buy new boots today.</p><a href=/buy>Buy now</a></div><p>{P2}</p><p>{P3}</p></main>', ["A bridge at last", P1, P2, P3]),
    "deep": ("<div>" * 9 + f"<h1>A bridge at last</h1><p>{P1}</p><p>{P2}</p>" + "</div>" * 9, ["A bridge at last", P1, P2]),
    "notice first": (f"<div><p>We use cookies to make this site work for you.</p><button>Accept</button></div><div><h1>A bridge at last</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div>", ["A bridge at last", P1, P2, P3]),
    "custom elements": (f"<my-app><my-nav><a href=/>Home</a><a href=/x>World</a></my-nav><my-story><h1>A bridge at last</h1><p>{P1}</p><p>{P2}</p></my-story><my-foot><a href=/t>Terms</a></my-foot></my-app>", ["A bridge at last", P1, P2]),
    "a list is the text": (f"<h1>Why a bridge</h1><ul><li>{P1}</li><li>{P2}</li><li>{P3}</li></ul>", ["Why a bridge", P1, P2, P3]),
}
