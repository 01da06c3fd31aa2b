"""Part of quarry; see the README for what lives here."""
