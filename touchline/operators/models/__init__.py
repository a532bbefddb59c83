"""Models of match results; each group (a league, a fold) is fitted in a task of its own."""
