"""Labelled pages, written for this package: main text stands between <!--[--> and <!--]-->."""

PAGES = [
    """<!DOCTYPE html><html><head><title>River walks</title><style>p{}</style><script>track(1)</script></head><body>
<header class="site-header"><a href="/">Home</a> <div class="tagline">Walks for every weekend of the year</div></header>
<nav><ul><li><a href="/a">North</a></li><li><a href="/b">South</a></li><li><a href="/c">Maps of the region</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site work and to count visits. <button>Accept</button></div>
<div class="ad">Waterproof boots at half the price, this week only, in all our shops.</div>
<article><!--[--><h1>Along the river to the old mill</h1><p>The path begins behind the church and follows the bank for two miles.</p>
<p>After the <a href="/bridge">second bridge</a> it climbs through <b>oak woods</b>, where the ground stays wet until May.<br>Take care after rain.</p>
<ul><li>Start early.</li><li>Carry water.</li></ul><blockquote>No walk in the county is better in autumn.</blockquote><!--]--></article>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten hills to climb</a></li><li><a href="/2">Where to swim</a></li></ul></aside>
<section class="comments" id="comments"><h2>Comments</h2><div class="comment"><p>I walked it last week and the bridge was closed, which nobody tells you.</p></div></section>
<footer>&copy; 2020 River Walks &middot; All rights reserved. Write to us at any time.</footer></body></html>""",
    """<html><body><div id="menu"><a href="/">Start</a> | <a href="/news">News</a> | <a href="/sport">Sport</a></div>
<div class="banner">Subscribe now and read everything for a month without paying anything at all.</div>
<div id="content"><!--[--><h2>Council agrees to mend the harbour wall</h2><div>The council voted on Tuesday to spend four million on the wall.</div>
<div>Work is to begin in spring, said the engineer, and to last two years.</div><table><tr><td>Cost</td><td>four million</td></tr></table><!--]--></div>
<div class="share-buttons"><a href="#">Share</a> <a href="#">Print</a></div>
<form action="/newsletter"><label>Your address</label><input name="e"><button>Send me the newsletter</button></form>
<div class="related">See also <a href="/x">Storm damage counted</a> <a href="/y">Ferry back in service</a></div>
<div id="footer">Contact, imprint, privacy. Published by the harbour press since 1901.</div></body></html>""",
    """<html><body><ul class="breadcrumbs"><li><a href="/">Top</a></li><li><a href="/r">Recipes</a></li></ul>
<main><!--[--><h1>Bread without kneading</h1><p>Mix flour, water, salt and a little yeast in a bowl and cover it.</p><p>Wait until the next day.</p>
<pre>500 g flour
400 g water</pre><p>Bake it in a closed pot, first hot, then less so.</p><!--]-->
<aside>Our shop has pots of every size and colour for this recipe and others.</aside><div class="advert">Flour from the mill, sent to your door within a day.</div>
<!--[--><p>The crust should ring when you knock.</p><!--]--></main>
<div class="user-comments"><p>Mine came out flat. What did I do wrong with the yeast?</p></div><div role="navigation"><a href="/p">Previous</a> <a href="/n">Next</a></div></body></html>""",
    """<html><body><div class="top-nav"><a href="/">A</a><a href="/b">B</a></div><div class="login-form">Sign in to write a reply or to save this page.</div>
<div class="post"><!--[--><p>First he measured the room, then he cut the boards, one after the other, all day long.</p>
<p>In the evening the floor lay there, pale and even, and it smelled of resin.</p><figure><img src="f.jpg"><figcaption>The floor on the first evening.</figcaption></figure><!--]--></div>
<div class="promo">Join thousands of readers who get our best stories by mail.</div><div class="copyright">Copyright by the author.</div></body></html>""",
]
