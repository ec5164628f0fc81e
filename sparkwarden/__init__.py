"""Privacy and secret audits of repositories, texts and image metadata on Spark."""
