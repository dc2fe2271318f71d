"""Pages written by hand in the manner of blogs, papers, wikis and shops, with their main text; no page is used in training."""

PAGES = [
    (  # a blog whose comments have neither class nor id, and hidden and advertising inline elements
        """<!doctype html><html><head><meta charset=utf-8><title>Bread</title><body><div id=page><div id=masthead><a href=/>The Slow Kitchen</a><p>Cooking without hurry since 2009</p></div>
<div class=hentry><h1>A loaf for the weekend</h1><p>Most people give up on rye bread after the first attempt, which is a pity. The second loaf is always better.</p>
<p>Mix the flour and water <span style="display:none">buy our cheap flour now</span>the evening before, and leave the bowl near a stove. <span class="advert">Flour, now 20% off!</span></p>
<ul><li>500 g of dark rye flour</li><li>400 ml of water, lukewarm</li><li>Salt</li></ul><p>Bake for an hour. Let it rest for a day before you cut it.</p></div>
<div><h3>3 Comments</h3><div><p>Anna: I tried this with spelt flour and it worked very well, thank you.</p></div><div><p>Tom: Mine came out flat. What did I do wrong, do you think?</p></div></div>
<div class=side><h4>About me</h4><p>I bake, I write, and I have two cats who help with neither.</p></div></div><div id=colophon>Powered by flour.</div></body></html>""",
        """A loaf for the weekend
Most people give up on rye bread after the first attempt, which is a pity. The second loaf is always better.
Mix the flour and water the evening before, and leave the bowl near a stove.
500 g of dark rye flour
400 ml of water, lukewarm
Salt
Bake for an hour. Let it rest for a day before you cut it.""",
    ),
    (  # a newspaper with a byline, share links, an inset promotion and related stories under a heading
        """<html><body><div class="site-header"><nav><a href=/news>News</a> <a href=/sport>Sport</a> <a href=/weather>Weather</a></nav></div><main><article><header><p>By Jane Miller, 4 May</p></header>
<h1>Council votes to reopen the river path</h1><div class="social-share"><a href=#>Post</a> <a href=#>Mail</a></div><p>The city council voted on Tuesday to reopen the path along the river, which had been closed since the flood of last autumn.</p>
<aside><p>Sign up for our morning briefing and never miss a story.</p></aside><p>Work on the embankment is to begin in June, said the mayor, and will cost about two million.</p><blockquote>It is the walk of my childhood.</blockquote>
<p>Residents had collected some 4,000 signatures.</p><div class="newsletter-box"><p>Get the best of our reporting, every Friday, for free.</p></div><p>The path should be open by spring.</p></article>
<section><h2>Related stories</h2><p>Flood: what we know so far about the damage, the costs and the plans.</p><p>Why the bridge stays closed for another year</p></section></main><footer><p>&copy; The Daily Herald. All rights reserved.</p></footer></body></html>""",
        """Council votes to reopen the river path
The city council voted on Tuesday to reopen the path along the river, which had been closed since the flood of last autumn.
Work on the embankment is to begin in June, said the mayor, and will cost about two million.
It is the walk of my childhood.
Residents had collected some 4,000 signatures.
The path should be open by spring.""",
    ),
    (  # a wiki with a table, a list of contents and a menu
        """<html lang=en><body class=skin><div id=mw-navigation><ul><li><a href=/a>Main page</a><li><a href=/b>Random article</a><li><a href=/c>Help</a></ul></div><div id=content><h1 id=firstHeading>Granite</h1>
<div id=toc class=toc><h2>Contents</h2><ul><li><a href=#1>Origin</a><li><a href=#2>Uses</a></ul></div><p><b>Granite</b> is a coarse-grained rock, composed mostly of quartz and feldspar. It forms from magma that cools slowly underground.</p>
<h2>Origin</h2><p>Granite has a high content of silica, and in most cases it is found in mountain ranges.</p><table><tr><th>Mineral</th><th>Share</th></tr><tr><td>Quartz</td><td>30 %</td></tr></table><h2>Uses</h2><p>It has been used for buildings, bridges and paving since antiquity.</p></div>
<div id=footer><ul><li>This page was last edited in March.<li><a href=/p>Privacy policy</a></ul></div></body></html>""",
        """Granite
Granite is a coarse-grained rock, composed mostly of quartz and feldspar. It forms from magma that cools slowly underground.
Origin
Granite has a high content of silica, and in most cases it is found in mountain ranges.
Mineral
Share
Quartz
30 %
Uses
It has been used for buildings, bridges and paving since antiquity.""",
    ),
    (  # old markup without sectioning elements
        """<HTML><HEAD><TITLE>Knots</TITLE></HEAD><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD><A HREF=a.htm>Home</A> | <A HREF=b.htm>Links</A></TD></TR></TABLE><H1>Knots for small boats</H1>
<P>The bowline is the first knot that a sailor should learn, for it holds well and is easily undone.<P>Make a small loop, bring the end up through it, around the back of the rope, and down again. Pull it tight.
<P>Practise it with eyes closed. At night, in rain, you will be glad of it.<HR><P><A HREF=mailto:x@y.z>Write to me</A></BODY></HTML>""",
        """Knots for small boats
The bowline is the first knot that a sailor should learn, for it holds well and is easily undone.
Make a small loop, bring the end up through it, around the back of the rope, and down again. Pull it tight.
Practise it with eyes closed. At night, in rain, you will be glad of it.""",
    ),
    (  # a German blog with a cookie notice, a form and reader comments under <article> elements of their own
        """<html lang=de><body><div class="cookie-banner"><p>Wir verwenden Cookies, um Ihnen die beste Erfahrung zu bieten. Sind Sie damit einverstanden?</p><button>Ja</button></div><header class=top><h2>Gartenblog</h2></header>
<article class=post><h1>Tomaten im Topf</h1><p>Wer keinen Garten hat, kann Tomaten auch auf dem Balkon ziehen. Wichtig sind ein großer Topf, viel Sonne und etwas Geduld.</p><p>Gegossen wird morgens, und zwar am Boden, nicht über die Blätter.</p>
<h2>Die Ernte</h2><p>Im August sind die ersten Früchte reif.</p><form action=/abo><label>E-Mail</label><input name=m><p>Abonnieren Sie unsere Post, kostenlos und jederzeit kündbar.</p></form></article>
<section id=comments><h2>2 Kommentare</h2><article><p>Bei mir hat das leider nicht geklappt, die Blätter wurden gelb.</p></article><article><p>Danke, sehr hilfreich!</p></article></section><footer>Impressum</footer></body></html>""",
        """Tomaten im Topf
Wer keinen Garten hat, kann Tomaten auch auf dem Balkon ziehen. Wichtig sind ein großer Topf, viel Sonne und etwas Geduld.
Gegossen wird morgens, und zwar am Boden, nicht über die Blätter.
Die Ernte
Im August sind die ersten Früchte reif.""",
    ),
    (  # a layout of div elements only, with names that a framework made up
        """<html><body><div class=x1f><div class=x2a><a href=/1>Start</a><a href=/2>Topics</a><a href=/3>Archive</a><a href=/4>Shop</a></div></div><div class=k9><div class=q7><h1>How owls hear</h1>
<p>An owl hears a mouse under snow at thirty metres. Its ears sit at different heights, so a sound from below reaches one of them first.</p><p>The difference is tiny, about a hundredth of a millisecond, but it is enough.</p><p>Feathers around the face gather the sound like a dish.</p>
<p>Young owls learn to use this map of sounds in their first weeks, while they still see the nest.</p></div><div class=q8><a href=/5>Why cats purr</a><a href=/6>How bees dance</a><a href=/7>What whales sing</a></div></div><div class=z3><a href=/8>Terms</a> <a href=/9>Imprint</a></div></body></html>""",
        """How owls hear
An owl hears a mouse under snow at thirty metres. Its ears sit at different heights, so a sound from below reaches one of them first.
The difference is tiny, about a hundredth of a millisecond, but it is enough.
Feathers around the face gather the sound like a dish.
Young owls learn to use this map of sounds in their first weeks, while they still see the nest.""",
    ),
    (  # documentation with code, definitions and a sidebar before the text; end tags left out
        """<!DOCTYPE html><title>sort</title><div class=sidebar role=navigation><ul><li><a href=a>grep</a><li><a href=b>sed</a><li><a href=c>sort</a></ul></div><main role=main><h1>sort</h1><p>Sorts the lines of text files, and writes them to the standard output.
<h2>Options</h2><dl><dt>-n<dd>Compare by numbers, not by characters.<dt>-r<dd>Reverse the result, so that the last line comes first.</dl><p>An example:<pre>sort -n   sizes.txt</pre><p>See also <a href=d>uniq</a>, which removes repeated lines.</main><footer><p>Version 9.1, <a href=e>report an error</a></footer>""",
        """sort
Sorts the lines of text files, and writes them to the standard output.
Options
-n
Compare by numbers, not by characters.
-r
Reverse the result, so that the last line comes first.
An example:
sort -n sizes.txt
See also uniq, which removes repeated lines.""",
    ),
    (  # a forum-like page with untitled replies under a class, and a pager
        """<html><body><div id=navbar><ul><li><a href=/>Board</a></li><li><a href=/s>Search</a></li></ul></div><div class=thread><div class="entry-content"><h1>My first telescope</h1><p>After years of looking at the sky with field glasses I bought a small telescope, and I want to tell you what I learned.</p>
<p>First, buy a good mount. Second, be patient: the air must be calm.</p><p>Saturn, seen for the first time, is worth all of it.</p></div><div class=replies><div class=reply><p>Welcome to the club! Which eyepiece do you use?</p></div><div class=reply><p>I still remember my first look at the rings, too.</p></div></div>
<div class=pagination><a href=1>1</a> <a href=2>2</a></div></div><div class="widget ads"><p>Telescopes at half price, this week only. Order now, pay later!</p></div></body></html>""",
        """My first telescope
After years of looking at the sky with field glasses I bought a small telescope, and I want to tell you what I learned.
First, buy a good mount. Second, be patient: the air must be calm.
Saturn, seen for the first time, is worth all of it.""",
    ),
]
