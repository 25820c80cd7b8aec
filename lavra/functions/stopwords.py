"""Stop-word lists by language code. Own lists of common function words; any list can be passed in."""

from __future__ import annotations

_PT = """a à ao aos aquela aquelas aquele aqueles aquilo as às até com como da das de dela delas dele
deles depois do dos e é ela elas ele eles em entre era eram essa essas esse esses esta está estamos
estão estas estava estavam este estes eu foi fomos for foram fosse há isso isto já lhe lhes mais mas
me mesmo meu meus minha minhas muito na não nas nem no nos nós nossa nossas nosso nossos num numa o
os ou para pela pelas pelo pelos por qual quando que quem são se seja sem ser será seu seus só sua
suas também te tem têm tinha tu tua tuas um uma você vocês"""

_EN = """a about above after again all am an and any are as at be because been before being below
between both but by can did do does doing down during each few for from further had has have having
he her here hers him his how i if in into is it its just me more most my no nor not now of off on
once only or other our ours out over own same she should so some such than that the their theirs
them then there these they this those through to too under until up very was we were what when
where which while who whom why will with you your yours"""

_FR = """à ai ainsi alors après as au aucun aussi autre aux avec avez avoir avons c ce cela ces cet
cette comme d dans de des donc dont du elle elles en entre est et été être eux fait il ils j je l la
le les leur leurs lui m ma mais me même mes moi mon n ne ni nos notre nous on ont ou où par pas plus
pour qu que quel quelle qui s sa sans se ses si son sont sous sur ta te tes toi ton tous tout très
tu un une vos votre vous y"""

_DE = """aber alle als also am an andere auch auf aus bei bin bis bist da damit dann das dass dein
dem den der des dich die dies diese diesem dieser dieses dir doch dort du durch ein eine einem einen
einer eines er es für hat hatte hier hin ich ihm ihn ihr ihre im in ist ja jede jeder kann kein keine
können man mein mich mir mit nach nicht noch nun nur ob oder ohne sehr sein seine sich sie sind so
soll über um und uns unter vom von vor war waren was weg weil wenn wer wie wieder will wir wird zu
zum zur"""

_ES = """a al algo algunos ante antes así aún bajo cada como con contra cual cuando de del desde donde
dos e el él ella ellas ellos en entre era es esa ese eso esta está estaba estado este esto estos fue
fueron ha había han hasta hay la las le les lo los más me mi mí mientras mis mucho muy nada ni no nos
nosotros o otra otro para pero poco por porque que qué quien se sea según ser si sí sido sin sobre
son su sus también tan tanto te tiene todo todos tu tus un una uno unos y ya yo"""

STOPWORDS: dict[str, tuple[str, ...]] = {
    lang: tuple(sorted(set(words.split())))
    for lang, words in {"pt": _PT, "en": _EN, "fr": _FR, "de": _DE, "es": _ES}.items()
}
