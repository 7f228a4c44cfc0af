"""Tables written by key and changed in place."""
