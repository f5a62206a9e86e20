"""Phrase tables of the text annotation.

Fixed values: these words decide which filter or hint a phrase turns into.
"""

CHANNEL_PHRASES = {
    "L": ("left wing", "left-wing", "left flank", "left touchline", "down the left",
          "wide left", "left side", "left byline"),
    "LI": ("left half-space", "left halfspace", "left half space", "inside-left",
           "inside left", "left channel", "left inside channel", "inside-left channel"),
    "C": ("centrally", "central", "centre", "center", "through the middle",
          "middle of the pitch", "down the middle"),
    "RI": ("right half-space", "right halfspace", "right half space", "inside-right",
           "inside right", "right channel", "right inside channel", "inside-right channel"),
    "R": ("right wing", "right-wing", "right flank", "right touchline", "down the right",
          "wide right", "right side", "right byline"),
}
BAND_PHRASES = {
    "D": ("own third", "defensive third", "own half", "from defence", "from defense",
          "from the back", "back line", "deep in their own half", "defensive area"),
    "M": ("middle third", "midfield", "centre of the pitch", "middle of the park"),
    "F": ("final third", "attacking third", "opposition half", "opponents half",
          "opponent's half", "attacking half", "forward third"),
}
ACTION_PHRASES = {
    "CROSS": ("cross", "crossed", "crosses", "crossing", "whipped in", "delivery"),
    "THROUGH": ("through ball", "through-ball", "played in behind", "in behind",
                "threaded", "slipped in", "split the defence"),
    "SWITCH": ("switch of play", "switched", "switch", "cross-field", "crossfield",
               "diagonal ball", "changed flanks", "other flank"),
    "DRIB": ("dribble", "dribbled", "dribbling", "beat his man", "beat their man",
             "took on", "take-on", "run at"),
    "CARRY": ("carry", "carried", "drove forward", "driving run", "ran with the ball",
              "overlapping run", "overlap"),
    "SHOT": ("shot", "shoots", "shoot", "effort", "attempt", "struck", "strike",
             "header", "headed goalward", "goalward", "finish"),
    "RECOV": ("turnover", "recovery", "recovered", "won the ball", "wins the ball",
              "regain", "won possession", "pressing high", "high press", "press high",
              "wins it back", "counter-press"),
    "INT": ("interception", "intercepted", "cut out"),
    "DUEL": ("duel", "tackle", "aerial duel"),
    "CLR": ("clearance", "cleared"),
    "LOSS": ("lost the ball", "dispossessed", "miscontrol", "gave it away"),
}
PATTERN_PHRASES = {
    "From Corner": ("corner", "corner kick"),
    "From Free Kick": ("free kick", "free-kick", "freekick", "set piece", "set-piece"),
    "From Throw In": ("throw-in", "throw in", "throwin"),
    "From Counter": ("counter-attack", "counter attack", "counterattack", "counter",
                     "on the break", "fast break", "transition"),
    "From Goal Kick": ("goal kick", "goal-kick", "goalkick"),
    "From Keeper": ("from the goalkeeper", "from the keeper", "from their keeper"),
    "From Kick Off": ("kick-off", "kick off", "kickoff"),
    "Regular Play": ("open play", "regular play"),
}
FLAG_PHRASES = {
    "cutback": ("cutback", "cut-back", "cut back", "squared it", "pulled it back",
                "laid it back"),
    "combo": ("one-two", "one two", "give and go", "give-and-go", "combination",
              "lay-off", "layoff", "lay off", "knock-down", "wall pass"),
    "shot": ("ends in a shot", "ending in a shot", "ends with a shot",
             "ending with a shot", "leads to a shot", "leading to a shot",
             "creates a shot", "results in a shot", "produces a shot",
             "that creates a shot", "shot at the end"),
    "goal": ("goal", "scored", "scoring", "scores", "ends in a goal", "finished off"),
    "box": ("into the box", "in the box", "inside the box", "penalty area",
            "penalty box", "six-yard box", "six yard box", "18-yard box"),
    "outside": ("outside the box", "from distance", "long range", "long-range",
                "edge of the box", "edge of the area"),
    "pressure": ("under pressure", "under heavy pressing", "pressure-resistant",
                 "heavy pressing", "under press", "pressed", "under the press"),
    "direct": ("long ball", "direct", "route one", "long pass"),
    "long": ("long possession", "extended possession", "sustained possession",
             "sustained spell", "long spell"),
    "patient": ("patient", "patiently", "keep-ball", "controlled possession"),
    "high_xg": ("high-xg", "high xg", "big chance", "clear chance", "clear-cut chance",
                "golden chance", "high quality chance"),
    "buildup": ("build-up", "build up", "building out", "playing out from the back",
                "played out from the back", "build out"),
    "rebound": ("rebound", "blocked", "parried", "second ball", "spilled",
                "loose ball", "follow-up"),
}
ATTACK_PHRASES = ("attack", "attacking", "break forward", "broke forward",
                  "immediate attack", "counter-attack", "forward")

START_PHRASES = ("own third", "own half", "from defence", "from defense", "from the back")
ARRIVAL_LEADS = ("into the", "reaches the", "to the", "arrives in", "reaching the")
DEFENSIVE_LEADS = ("from", "out of", "in their")
SHOT_WORDS = r"shots?|efforts?|attempts?|finish(?:ing|ed|es)?|headers?|strikes?"
BALL_WINNING = ("RECOV", "INT", "DUEL", "CLR")
CAN_MODIFY = ("PASS", "CROSS", "THROUGH", "SWITCH", "CARRY", "SETP")
ALWAYS_FORWARD = ("THROUGH", "SWITCH")
DISTINCTIVE = ("CROSS", "SWITCH", "THROUGH", "DRIB", "INT")
DEFAULT_BAND = {
    "CROSS": "F", "SHOT": "F", "DRIB": "F", "THROUGH": "M", "SWITCH": "M",
    "CARRY": "M", "PASS": "M", "RECOV": "M", "INT": "M", "DUEL": "M",
    "CLR": "D", "LOSS": "M", "SETP": "F",
}
# Restart: band, usual channel, played into the box.
RESTARTS = {
    "From Corner": ("F", "R", True),
    "From Free Kick": ("F", "LI", True),
    "From Throw In": ("F", "R", False),
    "From Goal Kick": ("D", "C", False),
    "From Kick Off": ("M", "C", False),
}
HIGH_XG, LONG_EVENTS, PATIENT_EVENTS = 0.3, 25, 20
NEAR, LEAD_IN, SHORTEST_HINT = 40, 22, 3
