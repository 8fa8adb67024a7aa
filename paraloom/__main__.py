from paraloom.cli import main

main()
