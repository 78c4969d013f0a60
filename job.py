"""spark-submit --py-files spendloom.zip job.py INPUT OUTPUT [options]; see spendloom/__main__.py."""

from spendloom.__main__ import main

if __name__ == "__main__":
    main()
