"""Word lists and phrase lists that features are counted by."""

from __future__ import annotations

# Phrases of each marker group; a sentence has a phrase if its lower-case text contains it.
MARKERS = {
    "curiosity": "nobody talks about|nobody tells you|no one talks about|what happens|the truth is|the real reason|here's why|heres why|turns out|most people|everyone thinks|people don't realize|people dont realise|you won't believe|you wont believe|what if|imagine if|the secret|nobody knows|the problem is|here's the thing|the question is|let me tell you|the crazy part|nobody asked",
    "contrast": "but |however|although|actually|turns out|instead|whereas|yet |even though|the thing is|in reality|surprisingly|unexpectedly|counterintuitive|opposite|except|magar|lekin|phir bhi|but the",
    "payoff": "so that's why|so thats why|that's why|thats why|in the end|eventually|and that's when|and thats when|which means|the lesson|since then|from then on|long story short|bottom line|the whole point|i realised|i realized|so i decided|so finally|the result|that changed|after that|and that's how|and thats how",
    "story": "i remember|when i was|one day|back then|at the time|suddenly|so i |we were|he said|she said|i started|i walked|i called|i met|i got|there was this|the first time|my friend|my mom|my dad|my wife|my boss|so basically|after that day|aur phir|ek din",
    "advice": "you should|you need to|you have to|make sure|the key is|the point is|here's how|heres how|one thing i learned|the trick|the mistake|stop doing|start doing|focus on|the best way|my advice|karna chahiye|never do",
    "humour": "[laughter]|(laughter)|haha|hahaha|lol|lmao|hilarious|funny|joke|kidding|crack up|comedy|seriously though|punchline",
    "controversy": "controversial|unpopular opinion|i disagree|that's wrong|thats wrong|nobody wants to hear|hate to say|overrated|underrated|everyone is wrong|the truth nobody|hot take|i don't agree|i dont agree|nonsense|scam|lie|lying|bullshit",
    "insight": "the reason|which means|that means|the principle|the framework|the difference between|what i learned|the takeaway|in other words|the mistake most|the trick is|rarely|usually|because of that",
    "intensity": "never|always|everything|nothing|everyone|nobody|insane|crazy|huge|massive|incredible|unbelievable|terrible|amazing|absolutely|completely|totally|desperately|literally|honestly",
    "absolutes": "never|always|everyone|nobody|no one|worst|best ever|every single",
    "continuation": "like i said|as i mentioned|as i said|back to what|so continuing|coming back to|as we discussed|before we move|jaisa maine bola|pehle bola tha",
    "profanity": "damn|hell|shit|fuck|fucking|bitch|crap|bastard|chutiya|saala",
    "emotion": "love|hate|cry|cried|crying|afraid|scared|angry|hurt|pain|proud|shame|hope|lonely|regret|grateful|broke|broken|died|death|heart|tears|fight|failed|failure|success|successful",
    "life_theme": "life|money|success|failure|fear|purpose|meaning|relationship|family|career|health|discipline|habit|mindset|confidence|zindagi|paisa",
}
MARKERS = {name: phrases.split("|") for name, phrases in MARKERS.items()}

# Words by what they count as.
FIRST_PERSON = "i me my mine we our us main mai mujhe mera meri hum humein".split()
DIRECT_ADDRESS = "you your you're youre tum aap tumhara aapko yaar guys bro".split()
PAST_TENSE = "was were had did went told said started thought felt came took gave knew tha thi gaya gayi hua hui".split()
POSITIVE = "great amazing love best happy proud beautiful success won worked grateful excited incredible".split()
NEGATIVE = "hate worst sad angry failed failure hurt pain lost scared afraid broke cry terrible".split()
IMPERATIVES = "do don't dont stop start try listen think remember imagine focus never always make".split()
NUMBER_WORDS = "million billion thousand crore lakh percent dollar dollars".split()
QUOTABLE = "never always everyone nobody truth people should reason problem life success failure money fear because most".split() + MARKERS["life_theme"]
QUESTION_STARTS = "what why how when where who which is are do does did can could would should have will kya kyun kaise kaun".split()
DEICTIC_STARTS = "this that these those it they he she him her them there then so and but because also which who when while another iski uska uski iske wo yeh ye vo".split()
CONJUNCTIONS = "and but so because then also aur lekin phir".split()
FILLERS = "um uh erm hmm mm ah eh like basically literally actually right matlab yaani wo arre haan toh".split()
STOPWORDS = (
    "the a an and or but if then than that this these those is are was were be been being am do does did doing have has had having "
    "i you he she it we they me him her us them my your his its our their of in on at to for with by from as about into over after "
    "so just not no yes what which who whom when where why how there here up down out will would can could should may might must "
    "get got go going know think really very much more most also because one two"
).split()

# Hundredths of the score that each factor gives and each penalty takes, and the power that spreads the result.
WEIGHTS = {"hook": 20, "standalone": 20, "story": 10, "payoff": 10, "engagement": 15, "emotion": 10, "novelty": 10, "shareability": 5}
PENALTIES = {"context_dependency": 30, "abrupt_start": 14, "abrupt_end": 12, "filler": 10, "low_confidence": 18, "repetition": 14, "weak_delivery": 12}
CURVE = 0.8

# What each factor and penalty is called where a choice is explained.
LABELS = {
    "hook": "Strong opening hook", "emotion": "High emotional intensity", "curiosity": "Open curiosity gap", "standalone": "Complete and understandable on its own",
    "story": "Full story arc", "payoff": "Clear payoff", "novelty": "Fresh angle, not repeated elsewhere", "shareability": "Quotable and shareable", "controversy": "Opinionated - drives comments",
    "practical": "Actionable advice", "humour": "Funny moment", "insight": "Explains the underlying reason", "unexpectedness": "Unexpected turn", "engagement": "Strong delivery and pacing",
    "context_dependency": "Needs earlier context", "abrupt_start": "Starts mid-thought", "abrupt_end": "Ends mid-thought", "filler": "Rambling / filler-heavy", "low_confidence": "Unclear audio or wording",
    "repetition": "Repeats earlier material", "weak_delivery": "Low speaking energy",
}
