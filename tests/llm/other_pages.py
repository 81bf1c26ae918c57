"""Pages written by hand in layouts that the training rules don't have, with their main text."""

BLOG = (
    """<!doctype html><html lang="en"><head><title>Soup</title><link rel=stylesheet href=a.css></head>
<body class="single single-post"><div id="page" class="hfeed site">
<header id="masthead" class="site-header"><p class="site-title"><a href="/">The Kitchen Shelf</a></p>
<nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main" class="site-main"><article id="post-41" class="post hentry">
<h1 class="entry-title">A soup for cold evenings</h1>
<div class="entry-content"><p>Last winter I learned that a good soup needs little more than time, an onion and some patience.</p>
<p>Start by cutting the onion into small cubes. Let them soften in butter until they are golden, which takes about ten minutes.</p>
<h2>What you need</h2><ul><li>Two onions</li><li>A litre of stock</li></ul>
<p>Serve it hot, with bread on the side.</p></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on soup</h2><ol class="comment-list"><li class="comment"><p>Lovely, I made it twice this week already!</p></li></ol></div></main>
<aside id="secondary" class="widget-area sidebar"><section class="widget"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/b">Bread</a></li><li><a href="/c">Cake</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info"><a href="https://x.example">Proudly powered by something</a></div></footer></div></body></html>""",
    "A soup for cold evenings Last winter I learned that a good soup needs little more than time, an onion and some patience. Start by cutting the onion into small cubes. Let them soften in butter until they are golden, which takes about ten minutes. What you need Two onions A litre of stock Serve it hot, with bread on the side.",
)

NEWS = (
    """<html><head><meta charset=utf-8><title>n</title></head><body><div class="top-bar navigation"><a href="/">News</a> | <a href="/sport">Sport</a> | <a href="/weather">Weather</a></div>
<div class="cookie-notice" role="dialog"><p>We use cookies to improve your experience. By going on you accept them.</p><button>Accept</button></div>
<div class="container"><div class="article-wrapper"><h1>River reaches highest level in forty years</h1>
<div class="article-text"><p>The river rose by another half metre on Tuesday, and officials asked people near the old bridge to leave their homes.</p>
<div class="advert"><p>Buy one pair of boots and get the second free.</p></div>
<p>&quot;We have not seen water like this since 1984,&quot; said the mayor, who spent the night with the fire brigade.</p>
<blockquote>It came up through the floor, and then it would not stop.</blockquote>
<p>Rain is expected to end on Thursday.</p></div></div>
<div class="sidebar related-links"><h3>Related</h3><ul><li><a href="/1">Bridge closed to traffic</a></li><li><a href="/2">How to fill sandbags</a></li></ul></div></div>
<div class="footer"><p>&copy; 2021 The Valley Paper. All rights reserved.</p><a href="/imprint">Imprint</a></div></body></html>""",
    'River reaches highest level in forty years The river rose by another half metre on Tuesday, and officials asked people near the old bridge to leave their homes. "We have not seen water like this since 1984," said the mayor, who spent the night with the fire brigade. It came up through the floor, and then it would not stop. Rain is expected to end on Thursday.',
)

MANUAL = (
    """<!DOCTYPE html><html><body><div class="navbar"><ul class="nav-links"><li><a href=1>Guide</a><li><a href=2>API</a><li><a href=3>Download</a></ul></div>
<div class="breadcrumbs"><a href="/">Docs</a> / <a href="/g">Guide</a></div>
<div role="main" class="document"><div class="section"><h1>Reading files</h1>
<p>The reader opens a file, checks its header and then returns one record at a time until the file ends.</p>
<p>If the header is damaged, the reader stops with an error. It never skips a record without saying so.</p>
<dl><dt>path</dt><dd>Where the file lies on the disk.</dd></dl></div></div>
<div class="sidebar"><h3>Contents</h3><ul><li><a href=x>Writing files</a></li></ul><form class="search"><input name=q><button>Search</button></form></div>
<footer>Copyright 2019, the authors. <a href="/about">About</a></footer></body></html>""",
    "Reading files The reader opens a file, checks its header and then returns one record at a time until the file ends. If the header is damaged, the reader stops with an error. It never skips a record without saying so. path Where the file lies on the disk.",
)

TABLES = (
    """<html><body bgcolor=white><table width=100%><tr><td colspan=2 class="header"><b>My homepage</b></td></tr>
<tr><td class="menu"><a href=a>Start</a><br><a href=b>Photos</a><br><a href=c>Guestbook</a></td>
<td class="content"><h2>Walking in the hills</h2><p>We left early, when the mist was still lying over the fields and nobody else was on the road.
<p>After two hours we reached the hut, and the view from there was worth every single step of the way up.</td></tr>
<tr><td colspan=2 class="footer"><small>Last changed in May. Best viewed at any size.</small></td></tr></table></body></html>""",
    "Walking in the hills We left early, when the mist was still lying over the fields and nobody else was on the road. After two hours we reached the hut, and the view from there was worth every single step of the way up.",
)

RECIPE = (
    """<!DOCTYPE html><html><body class="recipe-template"><div id="top-bar"><span>Free delivery on all orders over 30</span></div>
<header class="global-header"><a href="/" class="logo">Pan &amp; Spoon</a><form role="search" class="search-form"><label>Search</label><input><button>Go</button></form></header>
<main class="content"><article class="recipe"><header><h1>Flat bread in a pan</h1></header>
<p>This bread needs no oven and no yeast, and it is ready before the lentils are.</p>
<aside class="ad-slot"><p>Knives that stay sharp, now at half the price.</p></aside>
<ol><li>Mix the flour with salt and warm water.</li><li>Knead it until it no longer sticks to your hands.</li><li>Bake it in a dry pan, a minute on each side.</li></ol>
<p>Wrap the breads in a cloth so that they stay soft until everybody sits down.</p></article>
<section class="comments-section"><h3>Comments</h3><div class="comment-body"><p>Worked well with rye flour too, thank you so much for sharing it.</p></div><div class="comment-body"><p>Mine were a bit hard.</p></div></section></main>
<footer class="global-footer"><nav><a href="/contact">Contact</a><a href="/jobs">Jobs</a></nav><p>All rights reserved by Pan and Spoon Ltd.</p></footer></body></html>""",
    "Flat bread in a pan This bread needs no oven and no yeast, and it is ready before the lentils are. Mix the flour with salt and warm water. Knead it until it no longer sticks to your hands. Bake it in a dry pan, a minute on each side. Wrap the breads in a cloth so that they stay soft until everybody sits down.",
)

FORUM = (
    """<html><body><div id="wrapper"><div class="navigation"><a href="/">Index</a> | <a href="/new">New</a></div>
<div class="newsletter-popup"><p>Get our weekly letter with the best threads!</p><input><button>Subscribe</button></div>
<div id="main-content" class="post-content"><h1>How I repaired the old tractor</h1>
<p>The engine had not turned for eleven years when I bought it, and the seller told me that it never would again.</p>
<div class="sponsored"><p>Spare parts delivered overnight.</p></div>
<p>First I soaked the cylinders in oil for a week. Then I took a long bar and moved the flywheel by hand.</p>
<p>On the third Sunday it coughed, smoked and ran.</p>
<div id="respond" class="replies"><p>Great work! Which oil did you use for the cylinders, and how much of it?</p><p>I want to see a film of it.</p></div></div>
<div class="related-posts widget"><h4>You may also like</h4><ul><li><a href="/p1">Painting a barn</a></li></ul></div>
<div class="legal">Imprint and privacy</div></div></body></html>""",
    "How I repaired the old tractor The engine had not turned for eleven years when I bought it, and the seller told me that it never would again. First I soaked the cylinders in oil for a week. Then I took a long bar and moved the flywheel by hand. On the third Sunday it coughed, smoked and ran.",
)

PAGES = [BLOG, NEWS, MANUAL, TABLES, RECIPE, FORUM]
