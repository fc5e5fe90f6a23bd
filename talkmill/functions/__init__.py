"""Part of talkmill."""
