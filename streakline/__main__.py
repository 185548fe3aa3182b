from streakline.plans.run import main

main()
